import hashlib
import html
import os
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from groundweave.llm import chat, fingerprints, html_text, langid, licences, packing, pieces
from tests.llm.conftest import text


def test_langid_edges_and_accuracy(spark, odd_docs, no_docs):
    trees = langid.fit(odd_docs)
    got = {(r["doc_id"], r["lang_pred"]): r["score"] for r in langid.identify(odd_docs, trees).collect()}
    assert {(3, "und"), (4, "und"), (5, "und"), (9, "und"), (1, "en")} <= set(got)
    assert all(0 <= s <= 1 for s in got.values()) and got[3, "und"] == 0
    assert langid.identify(odd_docs, trees).count() == odd_docs.count()
    assert langid.fit(no_docs).langs == []
    assert {r["lang_pred"] for r in langid.identify(odd_docs, langid.fit(no_docs)).collect()} == {"und"}
    assert langid.identify(no_docs, trees).count() == 0


def test_langid_scores_are_exact_code_lengths():
    texts = {"a": b"abracadabra abra", "b": b"banana bandana"}
    grams, counts = [], []
    for t in texts.values():
        g, n = np.unique(langid.gram_codes(np.frombuffer(langid._PAD + t, "uint8")), return_counts=True)
        grams.append(g), counts.append(n.astype(float))
    trees = langid.ContextTrees(["a", "b"], grams, counts)

    def bits(train: bytes, new: bytes) -> float:
        padded, seen = langid._PAD + train, {}
        for i in range(langid.ORDER, len(padded)):
            for k in range(langid.ORDER + 1):
                seen.setdefault(padded[i - k : i], {}).setdefault(padded[i], 0)
                seen[padded[i - k : i]][padded[i]] += 1
        total, padded = 0.0, langid._PAD + new
        for i in range(langid.ORDER, len(padded)):
            p, weight = 0.0, 1.0
            for k in range(langid.ORDER, -1, -1):
                if own := seen.get(padded[i - k : i]):
                    n, d = sum(own.values()), len(own)
                    p += weight * own.get(padded[i], 0) / (n + d)
                    weight *= d / (n + d)
            total -= np.log2(p + weight / 256)
        return total

    new = [b"abra banana", b"zz", b"cadabra" * 50]
    want = [[bits(t, x) for t in texts.values()] for x in new]
    scorer = langid.Scorer(trees)
    assert np.allclose(scorer.texts(new), want) and np.allclose(scorer.texts(new), want)


def test_langid_learns_a_language_of_one_long_text(spark):
    """The sample is taken by pieces: a language that one text of 1.1 MB holds is learned within a fit of 200 kB, and no more than that is taken."""
    polish = "zażółć gęślą jaźń wszystkie dzieci naszego świata chodzą do szkoły "
    rows = [(i, text(60, i), "en") for i in range(400)] + [(1000, polish * 15_000, "pl")]
    trees = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), fit_bytes=200_000)
    asked = spark.createDataFrame([(1, polish * 2), (2, text(40, 900))], "doc_id long, text string")
    assert {r["doc_id"]: r["lang_pred"] for r in langid.identify(asked, trees).collect()} == {1: "pl", 2: "en"}


def test_langid_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.op1_langid(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.98


def test_sentencepiece_equals_library(spark, odd_docs, no_docs):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    assert pieces.chunkable(model)
    for source in (odd_docs, spark.read.parquet("/root/testdata/sf0.001/documents.parquet")):
        rows = source.select("doc_id", "text").collect()
        want = sorted((str(r[0]), [1, *model.encode(r[1] or ""), 2]) for r in rows)
        got = pieces.sentencepiece_ids(source, path).collect()
        assert sorted((str(r["doc_id"]), np.frombuffer(r["ids"], "<u4").tolist()) for r in got) == want
        assert all(r["decoded"] == model.decode(np.frombuffer(r["ids"], "<u4").tolist()) for r in got)
    assert pieces.sentencepiece_ids(no_docs, path).count() == 0


@pytest.mark.parametrize("t", ["", " ", "  ", "a ", " a  b ", "▁", "▁ ▁a", "\n\n x", "x" * 3000])
def test_sentencepiece_chunks(t):
    model, encode = pieces._encoder(public_tokenizers.path("piece_bpe_32k.model"))
    assert np.frombuffer(encode([t])[0], "<u4").tolist() == model.encode(t)


def test_packing_pieces_equal_library(spark, odd_docs, no_docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    model = Tokenizer.from_file(path)
    rows = packing.token_pieces(odd_docs, path, keep_ids=True).collect()
    own = {}
    for r in rows:
        assert r["length"] * 4 == len(r["ids"]) and zlib.crc32(r["ids"]) == r["ids_crc32"] and r["length"] <= 2048
        own.setdefault(r["doc_id"], []).append(r)
    texts = {r["doc_id"]: r["text"] or "" for r in odd_docs.collect()}
    for key, found in own.items():
        found = sorted({(r["piece"], r["start"], bytes(r["ids"])) for r in found})
        ids = np.frombuffer(b"".join(x for _, _, x in found), "<u4").tolist()
        assert ids == [*model.encode(texts[key], add_special_tokens=False).ids, 0]
        assert [s for _, s, _ in found] == list(np.cumsum([0, *[len(x) // 4 for _, _, x in found]])[:-1])
    assert packing.pack(packing.token_pieces(no_docs, path)).count() == 0


def test_packing_ids_of_given_documents_equal_library(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    model = Tokenizer.from_file(path)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    own = {}
    for r in packing.token_pieces(docs, path, keep_ids=True).collect():
        own.setdefault(r["doc_id"], []).append((r["piece"], bytes(r["ids"])))
    rows = docs.select("doc_id", "text").collect()
    wanted = model.encode_batch([r["text"] or "" for r in rows], add_special_tokens=False)
    assert all(np.frombuffer(b"".join(x for _, x in sorted(own[r["doc_id"]])), "<u4").tolist() == [*w.ids, 0] for r, w in zip(rows, wanted, strict=True))


def test_packing_fills_sequences_without_gaps(spark):
    rows = packing.op9_packing(spark, "/root/testdata/sf0.01").collect()
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    least = -(-sum(r["length"] for r in rows) // 2048)
    assert len(by) <= least * 1.01 + 1
    assert len({(r["doc_id"], r["piece"]) for r in rows}) == len(rows)


def test_packing_deals_a_frequent_length_and_equal_rows(spark):
    rows = [(i if i % 3 else None, i % 2, 7 if i % 5 else 3) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, piece int, length long")
    got = packing.pack(df, 10, ranked=8).collect()
    assert sorted((r["doc_id"] or -1, r["piece"], r["length"]) for r in got) == sorted((i or -1, p, n) for i, p, n in rows)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert len(by) == 160 and all(o == (n if len(v) > 1 and i else 0) for v in by.values() for i, (o, _) in enumerate(sorted(v)) for n in [sorted(v)[0][1]])


def test_packing_plan_matches_best_fit():
    counts = {9: 3, 7: 2, 4: 5, 2: 7, 1: 4, 10: 1}
    bins = []
    for n in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
        fit = min((b for b in bins if b + n <= 10), key=lambda b: 10 - b, default=None)
        if fit is None:
            bins.append(n)
        else:
            bins[bins.index(fit)] += n
    slots = packing.plan_slots(counts, 10)
    assert max(s[3] + s[2] for s in slots) == len(bins)
    assert {n: sum(s[2] for s in slots if s[0] == n) for n in counts} == counts


def test_chat_layouts_and_escapes(spark):
    schema = "conv_id long, record struct<messages:array<struct<role:string,content:string>>,prompt:string,completion:string,instruction:string,output:string,context:struct<system:string>>"
    hard = "\\### <turn>x</turn>\n\\s\\l\\n <"
    rows = [
        (1, ([("user", hard), ("assistant", hard), ("a\nb<", None), (None, "")], None, None, None, None, None)),
        (2, (None, "p", hard, None, None, None)),
        (3, (None, None, None, "i", "o", ("s",))),
        (4, (None, None, None, None, None, None)),
        (5, ([], None, None, None, None, None)),
        (None, (None, "p", "q", None, None, None)),
    ]
    out = chat.format_turns(chat.canonical_turns(spark.createDataFrame(rows, schema), "record"))
    read = {r["conv_id"]: ([tuple(t) for t in r["turns"]], r["learned"], r["formatted"]) for r in out.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.learned_text(F.col("formatted"), F.col("loss_mask")).alias("learned")).collect()}
    assert read[1][:2] == ([("user", hard), ("assistant", hard), ("a\nb<", ""), ("", "")], hard)
    assert read[2][:2] == ([("user", "p"), ("assistant", hard)], hard)
    assert read[3][:2] == ([("system", "s"), ("user", "i"), ("assistant", "o")], "o")
    assert read[4] == ([], "", "") and read[5] == ([], "", "") and read[None][1] == "q"
    assert "<" not in read[1][2].replace("<turn>", "").replace("</turn>", "")


def test_chat_of_no_rows_long_texts_and_clashing_names(spark):
    kinds = "conv_id long, turn long, role string, text string"
    none = chat.as_records(spark.createDataFrame([], kinds))
    assert chat.format_turns(chat.canonical_turns(none, "record")).count() == 0
    long = "<turn>\\n\n" * 60_000
    rows = [(1, 0, "user", long), (1, 1, "assistant", long), (1, 2, "user", None), (None, 0, None, "x"), (2, 0, "assistant", ""), (3, 5, "user", "late"), (3, 5, "user", "late")]
    given = spark.createDataFrame(rows, kinds).selectExpr("*", "1 AS record", "2 AS pos", "3 AS m", "4 AS _layout", "5 AS piece")
    out = chat.format_turns(chat.canonical_turns(chat.as_records(given), "record"))
    read = out.select("conv_id", chat.read_turns(F.col("formatted")).alias("turns"), chat.learned_text(F.col("formatted"), F.col("loss_mask")).alias("learned"))
    got = {r["conv_id"]: ([tuple(t) for t in r["turns"]], r["learned"]) for r in read.collect()}
    assert got == {1: ([("user", long), ("assistant", long), ("user", "")], long), None: ([("", "x")], ""), 2: ([("assistant", "")], ""), 3: ([("user", "late")] * 2, "")}


def test_chat_is_native(spark):
    plan = chat.op6_chat(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_licences(spark, no_docs):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    rows = [(1, mit), (2, "Hello.\nReleased under the MIT License.\nReleased under the MIT License. Bye"), (3, None), (4, ""), (5, mit.split("\n")[2]), (6, "This work is licensed under the GNU General Public License, version 3.\nLicensed under CC BY-NC 4.0."), (6, "x" * 100_000)]
    got = licences.scan(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS ids", "2 AS s", "3 AS left")).collect()
    assert sorted((r["doc_id"], r["licences"], r["n_matches"], r["n_left"]) for r in got) == [(1, "MIT", 1, 0), (2, "MIT", 2, 0), (3, "", 0, 0), (4, "", 0, 0), (5, "", 0, 1), (6, "", 0, 0), (6, "CC-BY-NC-4.0,GPL-3.0", 2, 0)]
    assert licences.scan(no_docs).count() == 0
    assert "Python" not in licences.op10_licences(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()


APACHE = """Copyright 2020 A. Author

   Licensed under the Apache License, Version 2.0 (the "License");
   you may not use this file except in compliance with the License.
   You may obtain a copy of the License at

       http://www.apache.org/licenses/LICENSE-2.0

   Unless required by applicable law or agreed to in writing, software
   distributed under the License is distributed on an "AS IS" BASIS,
   WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
   See the License for the specific language governing permissions and
   limitations under the License."""
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""
BSD_2 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD_3 = BSD_2 + """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
GPL = """This program is free software%s you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation%s either version %d of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""


def test_licences_on_wrapped_originals(spark):
    texts = {
        "Apache-2.0": [APACHE, APACHE.split("\n\n")[1].split("\n")[0], "# " + APACHE.replace("\n", "\n# "), "Licensed under the Apache License,\nVersion 2.0."],
        "MIT": [MIT, " * " + MIT.replace("\n", "\r\n * "), "Released under\nthe MIT License."],
        "BSD-2-Clause": [BSD_2],
        "BSD-3-Clause": [BSD_3],
        "GPL-3.0-or-later": [GPL % (":", ",", 3), GPL % (";", ";", 3)],
        "GPL-2.0-or-later": [GPL % (";", ";", 2), GPL % (":", ",", 2)],
        "GPL-3.0": ["This work is licensed under the GNU General Public\nLicense, version 3."],
        "GPL-2.0": ["This work is licensed under the GNU\nGeneral Public License, version 2."],
        "CC-BY-NC-4.0": ["Licensed under\nCC BY-NC 4.0."],
        "CC-BY-4.0": ["Licensed under CC BY\n4.0."],
        "CC-BY-SA-4.0": ["Licensed under CC\nBY-SA 4.0."],
    }
    assert set(texts) <= {name for name, _ in licences.RULES}
    want = [(i, name) for i, (name, t) in enumerate((n, t) for n, own in texts.items() for t in own)]
    rows = [(i, t) for i, t in enumerate(t for own in texts.values() for t in own)]
    rows.append((-1, "It is not\nlicensed under CC BY 4.0 and\nreleased under the MIT License too."))
    got = licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["licences"], r["n_matches"], r["n_left"]) for r in got) == [(-1, "", 0, 0)] + [(i, n, 1, 0) for i, n in want]


ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at http://mozilla.org/MPL/2.0/."""


def test_licences_with_names_marks_and_lines(spark):
    """Owners' names in sentences, list marks of all kinds, other addresses, further licences, lines of identifiers."""
    regents = BSD_3.replace("the copyright holder", "the University of California, Berkeley,")
    marked = BSD_3.replace("1. ", "(1) ").replace("2. ", "(2) ").replace("3. ", "(3) ")
    lettered = BSD_3.replace("1. ", "a) ").replace("2. ", "b) ").replace("3. ", "c) ")
    starred = BSD_3.replace("1. ", "* ").replace("2. ", "* ").replace("3. ", "* ")
    gnu = GPL % (":", ",", 3)
    lesser = gnu.replace("This program", "This library").replace("GNU General", "GNU Lesser General")
    want = [
        ("BSD-3-Clause", regents), ("BSD-3-Clause", marked), ("BSD-3-Clause", lettered), ("BSD-3-Clause", starred), ("BSD-2-Clause", BSD_2.replace("1. ", "(i) ").replace("2. ", "(ii) ")),
        ("Apache-2.0", APACHE.replace("http://", "https://")), ("MIT", MIT.replace("AUTHORS OR COPYRIGHT HOLDERS", "X CONSORTIUM")), ("ISC", ISC), ("ISC", ISC.replace("and/or distribute", "and distribute").replace("THE AUTHOR ", "ACME INC. ")),
        ("MPL-2.0", MPL), ("MPL-2.0", MPL.split(" If ")[0]), ("LGPL-3.0-or-later", lesser), ("LGPL-2.1-or-later", lesser.replace("version 3", "version 2.1").replace("software:", "software;")),
        ("AGPL-3.0-or-later", gnu.replace("GNU General", "GNU Affero General")), ("GPL-3.0-or-later", gnu.replace("This program", "This file")),
        ("Apache-2.0", "// SPDX-License-Identifier: Apache-2.0\nint x;"), ("GPL-2.0-only", "/* SPDX-License-Identifier: GPL-2.0-only */"), ("BSD-3-Clause", "# spdx-license-identifier: BSD-3-Clause"),
    ]
    rows = [(i, t) for i, (_, t) in enumerate(want)] + [(-1, None), (-2, ""), (-3, "SPDX-License-Identifier: Unknown-1.0\nsee 1 Redistribution"), (-4, BSD_2 + "Neither the name of " + "x " * 40 + "nor the names of its contributors may be used.")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS s", "3 AS ids", "4 AS a", "5 AS n_left")
    got = {r["doc_id"]: (r["licences"], r["n_matches"], r["n_left"]) for r in licences.scan(df).collect()}
    for i, (name, _) in enumerate(want):
        assert got[i] == (name, 1, 0), (i, name, got[i])
    assert got[-1] == got[-2] == got[-3] == ("", 0, 0) and got[-4] == ("BSD-2-Clause", 1, 0)


def test_licences_equal_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    got = [tuple(r) for r in licences.op10_licences(spark, "/root/testdata/sf0.01").collect()]
    assert sorted(got, key=str) == sorted(con.execute(licences.OP10_SQL).fetchall(), key=str)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header class="site-header"><h1>Site</h1></header>
<nav><ul><li>Home<li>About us</ul></nav><div class="cookie-notice">We use cookies <button>OK</button></div><!-- <p>not me</p> -->
<%s><h2>Title</h2><p>First  paragraph, long enough to be measured: it goes on &amp; on, and on &#8212; on.<p>Short.</p><script>var x = "</p>";</script>
<div class="ad">Buy now</div><p>Second <b>long</b> paragraph<br>of the article that goes on for quite some time as well, really.</p></%s>
<aside>Side</aside><form>Your mail <input></form><section id="comments"><p>I liked this so very much that I want to say it at length here, at great length.</p></section><footer>&copy; me</footer></body></html>"""
MAIN = "Title First paragraph, long enough to be measured: it goes on & on, and on — on. Short. Second long paragraph of the article that goes on for quite some time as well, really."


@pytest.mark.parametrize("tag", ["article", "main", "div"])
def test_html_main_text(tag):
    assert html_text.main_text(PAGE % (tag, tag)) == MAIN


LONG = [f"Paragraph {i} of the main text, which goes on for long enough to be measured by itself, as any paragraph of this page does." for i in range(3)]
CARD = '<article class="card"><h3>Card %d</h3><p>A few words.</p></article>'


def paragraphs(*texts):
    return "".join(f"<p>{t}</p>" for t in texts)


def test_html_main_text_outside_articles():
    cards = "".join(CARD % i for i in range(6))
    for page in ("<div>%s</div>%s", "<div>%s</div><article>A small inset</article>"):
        body = page.replace("%s", paragraphs(*LONG), 1).replace("%s", cards)
        assert html_text.main_text(f"<html><body>{body}</body></html>") == " ".join(LONG)
        assert html_text.main_text(f"<html><body><main>{body}</main></body></html>").startswith(" ".join(LONG))
    inset = f"<div>{paragraphs(*LONG[:2])}{CARD % 1}{paragraphs('Short.', LONG[2])}</div>"
    assert html_text.main_text(inset) == " ".join([*LONG[:2], "Short.", LONG[2]])
    both = f"<article>{paragraphs('First.', LONG[0])}</article><div>{paragraphs(LONG[1])}</div>{CARD % 1}"
    assert html_text.main_text(both) == f"First. {LONG[0]} {LONG[1]}"
    nested = f"<main><h1>Title</h1><article>{paragraphs(LONG[0])}</article></main>"
    assert html_text.main_text(nested) == f"Title {LONG[0]}"


@pytest.mark.parametrize("tag", ["article", "main", "div"])
@pytest.mark.parametrize("inset", ['<div class="ad"><p>Buy</p><p>now</p><p>or</p><p>never</p></div>', "<nav><ul><li>a<li>b<li>c<li>d<li>e</ul></nav>"])
def test_html_short_paragraphs_after_insets(tag, inset):
    page = f"<body><nav>Menu</nav><{tag}>{paragraphs(LONG[0])}{inset}{paragraphs('Short.', 'Shorter.')}{inset}{paragraphs('Last.')}</{tag}><footer>Foot</footer></body>"
    assert html_text.main_text(page) == f"{LONG[0]} Short. Shorter. Last."


def test_html_main_text_ends_at_menus():
    page = f"<div>{paragraphs(*LONG)}</div><nav><p>a</p><p>b</p><p>c</p></nav><div><p>Short and apart.</p></div>"
    assert html_text.main_text(page) == " ".join(LONG)


def test_html_names_in_articles_are_whole_roles():
    parts = '<div class="related-work"><p>Earlier work measured the same.</p></div><p class="share">A share of one tenth.</p><div class="share-buttons">Tweet</div><div class="ad-slot">Buy</div><div class="comments"><p>First!</p></div>'
    assert html_text.main_text(f"<article><p>{'A long paragraph of the article. ' * 9}</p>{parts}</article>").endswith("Earlier work measured the same. A share of one tenth.")


def test_html_deep_pages_take_linear_time():
    import time

    took = []
    for n in (4000, 32000):
        began = time.process_time()
        assert html_text.main_text("<div>" * n + "deep text " * 20 + "</div>" * n) == ("deep text " * 20).strip()
        took.append(time.process_time() - began)
    assert took[1] < 30 * took[0] + 0.5


@pytest.mark.parametrize("article", [0, 1])
def test_html_distribution_brute_force(article):
    """Surge and dive points by the definition, in articles and outside: a line is kept if it measures something and no window between it and
    one of more than SURGE characters falls to DIVE, where lines count more in articles and paragraphs."""
    rng = np.random.default_rng(3)
    for _ in range(300):
        sizes = rng.choice([0, 0, 5, 15, 30, 60, 200], int(rng.integers(1, 30)))
        lines = [html_text.Line("x" * int(n), False, 0.0, article, 0, bool(rng.integers(2))) for n in sizes]
        placed = []
        for line in lines:
            if line.text or not article or placed and placed[-1].text:
                placed.append(line)
        weight = lambda x: len(x.text) + (bool(x.text) and (html_text.ARTICLE if article else html_text.PARAGRAPH * x.paragraph))
        plain = [sum(len(x.text) for x in placed[i : i + html_text.WINDOW]) for i in range(len(placed))]
        heavy = [sum(weight(x) for x in placed[i : i + html_text.WINDOW]) for i in range(len(placed))]
        most = max(plain, default=0)
        level = html_text.SURGE if most > html_text.SURGE else most - 1
        lives = [h > min(html_text.DIVE, level) or p > level for h, p in zip(heavy, plain, strict=True)]
        surges = [k for k, p in enumerate(plain) if p > level]
        want = [x.text for i, x in enumerate(placed) if x.text and any(all(lives[min(i, k) : max(i, k) + 1]) for k in surges)]
        assert html_text.main_lines(lines) == (want if most else [])


def test_html_marks_dont_decide():
    """Where the result is another than that of 'all of the article' or of 'all that no name rules out'."""
    words = "word " * 60
    short = "".join(f"<p>x{i}</p>" for i in range(40))
    assert html_text.main_text(f"<article><p>{words}</p>{short}</article>").endswith(" x38 x39")  # the article's own short paragraphs
    bare = f"<div><p>{words}</p></div><div>All rights reserved</div><div>Contact us</div><div>Phone 123</div>"
    assert html_text.main_text(bare) == words.strip()
    assert html_text.main_text(f"<div>Home</div><div>Login</div><div><p>{words}</p><p>End.</p></div>") == f"{words}End."
    for name in ('class="content-header"', 'id="search-results"', 'class="news-article-ad-free"'):
        assert html_text.main_text(f"<div {name}>{words}</div>") == words.strip()
    for name in ('class="site-header"', 'class="main-navigation"', 'id="post-comments"', 'class="footer-widget-area"'):
        assert html_text.main_text(f"<div {name}>{words}</div><p>Other {words}</p>") == f"Other {words.strip()}"
    teaser = "<article><p>Too short to surge.</p></article>"
    assert html_text.main_text(f"{teaser}<div><p>{words}</p></div>") == words.strip()


def test_html_given_pages_keep_their_articles():
    """On the given pages, whose articles are one run of text each, nothing of an article is lost and nothing else comes in."""
    import duckdb

    for (page,) in duckdb.execute("SELECT html FROM '/root/testdata/sf0.01/pages.parquet'").fetchall():
        inner = re.search("<article>(.*?)</article>", page, re.S)[1]
        want = html.unescape(re.sub(r"<(/?p|/?h\d|br)[^>]*>", " ", inner).replace("<b>", "").replace("</b>", ""))
        assert html_text.main_text(page) == " ".join(want.split())


def test_html_edges(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<p>Only a few words"), (3, "u", "<nav>menu</nav>"), (4, "u", "<article><p>cut off in the mid &am"), (None, "u", "<script>never closed <p>x"), (5, "u", "<p>" * 2000 + "deep" + "x " * 50_000)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS _place")).collect()
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert sorted((str(r["page_id"]), r["text"][:40]) for r in got) == [("1", ""), ("2", ""), ("3", ""), ("3", "Only a few words"), ("4", "cut off in the mid &am"), ("5", ("deep" + "x " * 18)), ("None", "")]


def plain_sketch(t: str) -> tuple[str, list[int]]:
    """A fingerprint and its sketch by whole numbers of Python, each span hashed from its own code points."""
    hashed = lambda x, base, p: sum((ord(c) + 1) * pow(base, k, p) for k, c in enumerate(x)) % p
    size, mask, least = min(fingerprints.SPAN, len(t)), (1 << 64) - 1, {}
    for i in range(len(t) - size + 1 if t else 0):
        x = hashed(t[i : i + size], fingerprints.BASE1, fingerprints.P1) * 0x9E3779B97F4A7C15 & mask
        x = (x ^ x >> 29) * 0xBF58476D1CE4E5B9 & mask
        least[x % fingerprints.BINS] = min(least.get(x % fingerprints.BINS, mask), x >> 6)
    slots = [least[i] & 65535 if i in least else 65536 for i in range(fingerprints.BINS)]
    whole = f"{hashed(t, fingerprints.BASE1, fingerprints.P1):08x}{hashed(t, fingerprints.BASE2, fingerprints.P2):08x}{len(t):08x}"
    return whole + "".join("----" if s == 65536 else f"{s:04x}" for s in slots), slots


def plain_likeness(a: list[int], b: list[int]) -> float:
    held = [x == y for x, y in zip(a, b, strict=True) if (x, y) != (65536, 65536)]
    return sum(held) / len(held) if held else 1.0


def test_fingerprints_brute_force(spark, odd_docs, no_docs):
    for source in (odd_docs, spark.read.parquet("/root/testdata/sf0.001/documents.parquet")):
        rows = sorted(((r[0], r[1] or "") for r in source.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        want = []
        for i, (key, own) in enumerate(rows):
            after = rows[(i + 1) % len(rows)][1]
            half = len(own) // 2
            edited = own[: len(own) - half] + after[:half]
            (a, sa), (b, sb), (_, sc) = (plain_sketch(x) for x in (own, edited, after))
            common = (len(os.path.commonprefix([own, x])) for x in (edited, after))
            want.append((str(key), len(own), hashlib.sha256(edited.encode()).hexdigest(), a, b, plain_likeness(sa, sb), plain_likeness(sa, sc), *common))
        got = [tuple(r) for r in fingerprints.edited_neighbours(source).collect()]
        assert sorted((str(r[0]), *r[1:]) for r in got) == sorted(want)
    assert fingerprints.edited_neighbours(no_docs).count() == 0


def test_prefix_hashes_answer_spans_and_extensions():
    a, b = fingerprints.Prefixes("hello brave new world"), fingerprints.Prefixes("oh brave new words")
    assert a.span(5, 11) == b.span(2, 11) and a.span(0, 3) != b.span(0, 3)
    assert fingerprints.common_extension(a, 5, b, 2) == len(" brave new wor")
    assert fingerprints.likeness(*(fingerprints.sketch(t)[1] for t in (text(50), text(50)))) == 1.0
    assert fingerprints.likeness(fingerprints.sketch("")[1], fingerprints.sketch("")[1]) == 1.0
