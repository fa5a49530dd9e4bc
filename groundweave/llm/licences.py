"""Operator 10, licence scans: sentences become identifiers, ordered rules match runs of identifiers.

All of it is DataFrame expressions on one row at a time, with no shuffle: a text is cut into pieces at line ends and
marks, each is normalised (A-Z to lower case, every run of other characters than a-z and 0-9 to one space, trimmed), and
the known licence sentences are found among them. A known sentence begins with a piece, maybe behind a list mark, and ends with one; in between it
may be cut anywhere, as wrapped lines and marks inside a sentence cut it. Where licences leave room for a name, so does the sentence (a hole of up to
HOLE words). A sentence's identifier is its number. A rule is an ordered list of sentences; it matches where they follow each other in the
text's sequence of recognised sentences. Longer rules go first, and what they match counts for no shorter rule.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundweave.llm.common import table

#: Known licence sentences by key, as they are written; ... leaves room for a name. Fixed values.
SENTENCES = {
    "apache": ("Licensed under the Apache License, Version 2.0", "Licensed under the Apache License, Version 2.0 (the License)"),
    "apache use": ("you may not use this file except in compliance with the License",),
    "apache copy": ("You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0"),
    "apache as is": ("Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",),
    "apache see": ("See the License for the specific language governing permissions and limitations under the License",),
    "mit": ("Released under the MIT License", "Licensed under the MIT License"),
    "mit grant": ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",),
    "mit notice": ("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software", "The above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or substantial portions of the Software"),
    "mit as is": ("THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",),
    "mit liable": ("IN NO EVENT SHALL ... BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE",),
    "bsd": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",),
    "bsd source": ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",),
    "bsd binary": ("Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",),
    "bsd names": ("Neither the name of ... nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "The name of ... may not be used to endorse or promote products derived from this software without specific prior written permission", "Neither the name of ... nor the names of ... may be used to endorse or promote products derived from this software without specific prior written permission"),
    "isc": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    "isc as is": ("THE SOFTWARE IS PROVIDED AS IS AND ... DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS",),
    "isc liable": ("IN NO EVENT SHALL ... BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE",),
    "mpl 2": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",),
    "mpl copy": ("If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/"),
    "gpl 3": ("This work is licensed under the GNU General Public License, version 3",),
    "gpl 2": ("This work is licensed under the GNU General Public License, version 2",),
    "gpl 3 or later": ("This ... is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",),
    "gpl 2 or later": ("This ... is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",),
    "lgpl 3 or later": ("This ... is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",),
    "lgpl 2.1 or later": ("This ... is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",),
    "agpl 3 or later": ("This ... is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",),
    "gnu hope": ("This ... is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",),
    "gpl see": ("See the GNU General Public License for more details",),
    "lgpl see": ("See the GNU Lesser General Public License for more details",),
    "agpl see": ("See the GNU Affero General Public License for more details",),
    "cc by-nc": ("Licensed under CC BY-NC 4.0",),
    "cc by": ("Licensed under CC BY 4.0",),
    "cc by-sa": ("Licensed under CC BY-SA 4.0",),
}
#: Names that a line "SPDX-License-Identifier: name" may give: fixed values.
SPDX = (
    "0BSD AGPL-3.0-only AGPL-3.0-or-later Apache-2.0 BSD-2-Clause BSD-3-Clause BSL-1.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-SA-4.0 CC0-1.0 EPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later"
    " ISC LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later MIT MPL-2.0 Unlicense Zlib"
).split()
#: Ordered rules: licence and its sentences in order; longer ones go first. Fixed values.
RULES = (
    ("Apache-2.0", ("apache", "apache use", "apache copy", "apache as is", "apache see")),
    ("MIT", ("mit grant", "mit notice", "mit as is", "mit liable")),
    ("BSD-3-Clause", ("bsd", "bsd source", "bsd binary", "bsd names")),
    ("GPL-3.0-or-later", ("gpl 3 or later", "gnu hope", "gpl see")),
    ("GPL-2.0-or-later", ("gpl 2 or later", "gnu hope", "gpl see")),
    ("LGPL-3.0-or-later", ("lgpl 3 or later", "gnu hope", "lgpl see")),
    ("LGPL-2.1-or-later", ("lgpl 2.1 or later", "gnu hope", "lgpl see")),
    ("AGPL-3.0-or-later", ("agpl 3 or later", "gnu hope", "agpl see")),
    ("BSD-2-Clause", ("bsd", "bsd source", "bsd binary")),
    ("ISC", ("isc", "isc as is", "isc liable")),
    ("MPL-2.0", ("mpl 2", "mpl copy")),
    ("MPL-2.0", ("mpl 2",)),
    ("Apache-2.0", ("apache",)),
    ("MIT", ("mit",)),
    ("GPL-3.0", ("gpl 3",)),
    ("GPL-2.0", ("gpl 2",)),
    ("CC-BY-NC-4.0", ("cc by-nc",)),
    ("CC-BY-4.0", ("cc by",)),
    ("CC-BY-SA-4.0", ("cc by-sa",)),
    *((name, (f"spdx {name}",)) for name in SPDX),
)
#: Words of a name that a sentence leaves room for, at most.
HOLE = 12

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A piece ends at a line end, or at one of these marks with white space after it.
_ENDS = r"([.!?;:])[ \t\r\n\f]+"
#: What may stand before a sentence as the mark of a list: 1, a, iv.
_MARK = "(?:[0-9]{1,2}|[a-h]|[ivx]{1,4})"
#: Between the words of a sentence.
_GAP = "[ |]+"


def _normal(text: str) -> str:
    return re.sub("[^a-z0-9]+", " ", text.lower()).strip()


def _wordings() -> list[tuple[str, int, str]]:
    """(pattern, identifier, wording; a wording with room for a name is empty) of all known sentences, the longest first."""
    numbers = _numbers()
    known = [(w, numbers[key]) for key, forms in SENTENCES.items() for w in forms] + [(f"SPDX-License-Identifier: {name}", numbers[f"spdx {name}"]) for name in SPDX]
    out = []
    for wording, number in known:
        parts = [_normal(p) for p in wording.split("...")]
        hole = f"{_GAP}(?:[a-z0-9]+{_GAP}){{1,{HOLE}}}?"
        pattern = hole.join(_GAP.join(p.split(" ")) for p in parts)
        out.append((pattern, number, parts[0] if len(parts) == 1 else ""))
    return sorted(out, key=lambda x: -len(x[0]))


def _numbers() -> dict[str, int]:
    """Identifiers by key: whole numbers from 1, in the order of the tables."""
    return {key: i for i, key in enumerate((*SENTENCES, *(f"spdx {name}" for name in SPDX)), 1)}


def _run(keys: tuple[str, ...]) -> str:
    """A rule as it stands in a text's string of identifiers."""
    numbers = _numbers()
    return "".join(f"#{numbers[k]} " for k in keys)


def sentences(text: Column) -> Column:
    """Normalised pieces of a text, in order; empty ones stay, as positions."""
    lower = F.translate(text, _UPPER, _LOWER)
    cut = F.split(F.regexp_replace(lower, _ENDS, "$1\n"), "\n")
    return F.transform(cut, lambda s: F.trim(F.regexp_replace(s, "[^a-z0-9]+", " ")))


def identifiers(normalised: Column) -> Column:
    """The identifiers of the known sentences in an array of normalised pieces, in order, each as # and its number and a blank."""
    known = _wordings()
    joined = F.concat(F.lit("|"), F.array_join(normalised, "|"), F.lit("|"))
    found = F.regexp_extract_all(joined, F.lit(rf"(?<=\|)(?:{_MARK} )?(?:{'|'.join(p for p, *_ in known)})(?=\|)"), F.lit(0))
    plain = F.create_map(*(F.lit(x) for _, number, wording in known if wording for x in (wording, f"#{number} ")))

    def identifier(s: Column) -> Column:
        own = F.regexp_replace(F.regexp_replace(s, _GAP, " "), f"^{_MARK} (?=[a-z]{{3}})", "")
        named = F.try_element_at(plain, own)
        for pattern, number, wording in known:
            if not wording:
                named = F.coalesce(named, F.when(F.rlike(own, F.lit(f"^(?:{pattern})$")), F.lit(f"#{number} ")))
        return named

    return F.concat_ws("", F.transform(found, identifier))


def scan(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per row of df: id_col, n_sentences (pieces that aren't empty), n_recognised, licences (sorted names, a comma between),
    n_matches (rules matched, with repeats), n_left (recognised sentences of no matched rule).

    Null and empty texts have no sentence and match nothing. Repeated rows stay; other columns are left out, whatever their names.
    """
    cut = df.select(F.col(id_col).alias("id"), sentences(F.coalesce(F.col(text_col), F.lit(""))).alias("s"))
    rest = cut.select("id", F.size(F.filter("s", lambda x: x != "")).cast("long").alias("n_sentences"), identifiers(F.col("s")).alias("ids"))
    # A rule at a time would nest each step in the next; as an aggregate over the table of rules it is one expression, and none where nothing was found.
    rules = F.array(*(F.struct(F.lit(name).alias("name"), F.lit(_run(keys)).alias("run"), F.lit(len(keys)).alias("size")) for name, keys in RULES))
    start = F.struct(F.col("ids").alias("left"), F.array().cast("array<string>").alias("names"), F.lit(0).cast("long").alias("n"))

    def apply(a: Column, r: Column) -> Column:
        without = F.replace(a["left"], r["run"], F.lit("."))
        times = F.floor((F.length(a["left"]) - F.length(without)) / (F.length(r["run"]) - 1))
        return F.struct(without.alias("left"), F.when(times > 0, F.array_append(a["names"], r["name"])).otherwise(a["names"]).alias("names"), (a["n"] + times).cast("long").alias("n"))

    judged = rest.select("id", "n_sentences", "ids", F.when(F.col("ids") != "", F.aggregate(rules, start, apply)).alias("a"))
    count = lambda c: (F.length(c) - F.length(F.replace(c, F.lit("#"), F.lit("")))).cast("long")
    names = F.coalesce(F.array_join(F.array_sort(F.array_distinct("a.names")), ","), F.lit(""))
    left = F.coalesce(count(F.col("a.left")), F.lit(0).cast("long"))
    return judged.select(F.col("id").alias(id_col), "n_sentences", count(F.col("ids")).alias("n_recognised"), names.alias("licences"), F.coalesce("a.n", F.lit(0).cast("long")).alias("n_matches"), left.alias("n_left"))


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licences that every document's sentences name."""
    return scan(table(spark, sf_dir, "documents"))


#: The notices of one line by their own pieces, without the operator's tables: so it agrees where documents hold these and no others.
OP10_SQL = r"""
WITH pieces AS (
  SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(coalesce(text, ''), '([.!?;:])[ \t\r\n\f]+', '\1' || chr(10), 'g'), '\n'), lambda x: regexp_matches(x, '[A-Za-z0-9]')) AS p FROM documents),
named AS (
  SELECT doc_id, len(p) AS n_sentences, list_filter(list_transform(p, lambda x: CASE
      WHEN regexp_matches(x, '^\W*licensed under the apache license\W+version 2\.0\W*$', 'i') THEN 'Apache-2.0'
      WHEN regexp_matches(x, '^\W*(released|licensed) under the mit license\W*$', 'i') THEN 'MIT'
      WHEN regexp_matches(x, '^\W*this work is licensed under the gnu general public license\W+version 3\W*$', 'i') THEN 'GPL-3.0'
      WHEN regexp_matches(x, '^\W*this work is licensed under the gnu general public license\W+version 2\W*$', 'i') THEN 'GPL-2.0'
      WHEN regexp_matches(x, '^\W*licensed under cc by.nc 4\.0\W*$', 'i') THEN 'CC-BY-NC-4.0'
      WHEN regexp_matches(x, '^\W*licensed under cc by.sa 4\.0\W*$', 'i') THEN 'CC-BY-SA-4.0'
      WHEN regexp_matches(x, '^\W*licensed under cc by 4\.0\W*$', 'i') THEN 'CC-BY-4.0' END), lambda x: x IS NOT NULL) AS names FROM pieces)
SELECT doc_id, CAST(n_sentences AS BIGINT) AS n_sentences, CAST(len(names) AS BIGINT) AS n_recognised, coalesce(array_to_string(list_sort(list_distinct(names)), ','), '') AS licences,
       CAST(len(names) AS BIGINT) AS n_matches, CAST(0 AS BIGINT) AS n_left FROM named
"""
