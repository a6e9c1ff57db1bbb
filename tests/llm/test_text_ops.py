import hashlib
import random

import pytest
from compare import duck_rows, spark_rows

from keelspark.llm import chat_format, decontaminate, html_extract, langid, license_scan, quality, queries


def test_license_sql(spark, duck, sf):
    assert spark_rows(queries.op2_license(spark, sf)) == duck_rows(duck.sql(queries.oracle_sql()["op2_license"]))


def test_license_rules(spark):
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
    end = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    cases = {"Released under the MIT License.": "MIT", "x\nLicensed under CC BY-NC 4.0.\ny": "CC-BY-NC-4.0", bsd: "BSD-2-Clause", bsd + end: "BSD-3-Clause", "All rights reserved. Licensed under the Apache License, Version 2.0.": "Apache-2.0;proprietary-notice", "": "", "licence reserved": "", "RELEASED   UNDER the mit-license!  ": "MIT"}
    rows = [(i, t) for i, t in enumerate(cases)] + [(99, None)]
    got = {r.doc_id: r.licenses for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: w for i, w in enumerate(cases.values())} | {99: ""}
    told = [k.replace("@", "licensed under the ") for k in license_scan.KNOWN]
    assert all(any(a in k for a in anchors) for anchors in (license_scan.ANCHORS, license_scan.TEXT_ANCHORS) for k in told)
    assert len(license_scan.RULES) > 35


WRAPPED = {
    "MIT": """MIT License

Copyright (c) 2020 Some Body

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.""",
    "Apache-2.0": """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.""",
    "LGPL-2.1": """ * This library is free software; you can redistribute it and/or
 * modify it under the terms of the GNU Lesser General Public
 * License as published by the Free Software Foundation; either
 * version 2.1 of the License, or (at your option) any later version.
 *""",
    "GPL-2.0": """    This program is free software; you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation; either version 2 of the License, or
    (at your option) any later version.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.""",
    "MPL-2.0": """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/. */""",
    "Zlib": """Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim it.

2. Altered source versions must be plainly marked as such.

3. This notice may not be removed or altered from any source distribution.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means.""",
}


def test_wrapped_licenses(spark, tmp_path):
    import duckdb

    bsd2 = WRAPPED["BSD-3-Clause"].split("3. Neither")[0]
    cases = {f"some words\n\n{t}\n\nmore words": i for i, t in WRAPPED.items()}
    cases |= {t.replace("\n", "\r\n"): i for i, t in WRAPPED.items()}
    cases |= {"\n".join("// " + x for x in WRAPPED["MIT"].split("\n")): "MIT", bsd2: "BSD-2-Clause", WRAPPED["BSD-3-Clause"] + "\n\nother part\n\n" + bsd2: "BSD-2-Clause;BSD-3-Clause"}
    cases |= {"SPDX-License-Identifier: EPL-2.0\nint x;": "EPL-2.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "CC-BY-SA-4.0", "Distributed under the terms of the\nGNU Affero General Public License, version 3.": "AGPL-3.0"}
    cases |= {"intro line\nReleased under the Unlicense\nnext line": "Unlicense", "the software is under the isc rules": "", "This project is available under the Boost Software License, Version 1.0!": "BSL-1.0", "made by people": "", "Licensed under CC0 1.0. Licensed under the 2-clause BSD license.": "BSD-2-Clause;CC0-1.0", WRAPPED["MIT"].split("\n\n")[2] + " too": ""}
    cases["word " * 200_000 + "\n\n" + WRAPPED["MIT"] + "\n\n" + "word " * 100_000] = "MIT"
    rows = [(i, t, "x") for i, t in enumerate(cases)] + [(900, None, "x"), (900, None, "x"), (None, WRAPPED["ISC"], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, licenses string")
    got = license_scan.scan(df).collect()
    told = {r.doc_id: r.licenses for r in got}
    assert {c[-300:]: told[i] for i, c in enumerate(cases)} == {c[-300:]: w for c, w in cases.items()}
    assert told[900] == "" and told[None] == "ISC" and len(got) == len(rows)
    df.select("doc_id", "text").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert spark_rows(license_scan.scan(df)) == duck_rows(con.sql(license_scan.oracle()))
    assert license_scan.scan(df.limit(0)).count() == 0


def distance(pattern, text):
    """Sellers' recurrence: least distance of the pattern to any substring."""
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        prev, row[0] = row[0], 0
        for i, p in enumerate(pattern, 1):
            prev, row[i] = row[i], min(row[i] + 1, row[i - 1] + 1, prev + (p != c))
        best = min(best, row[-1])
    return best


def test_myers():
    rng = random.Random(3)
    for _ in range(300):
        p = "".join(rng.choice("abc") for _ in range(rng.randint(1, 70)))
        t = "".join(rng.choice("abc") for _ in range(rng.randint(0, 90)))
        assert decontaminate.best_match(decontaminate.peq(p), len(p), t)[0] == distance(p, t)


def edited(rng, text, k):
    s = list(text)
    for _ in range(k):
        i = rng.randrange(len(s))
        kind = rng.randrange(3)
        if kind == 0:
            s[i] = rng.choice("xyz")
        elif kind == 1:
            s.insert(i, rng.choice("xyz"))
        else:
            del s[i]
    return "".join(s)


def test_leaks_against_all_pairs(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    items = [(i, " ".join(word() for _ in range(25))) for i in range(12)] + [(50, "too short"), (51, None), (52, ""), (53, None)]
    items.append((60, items[0][1].upper() + "!"))
    docs = []
    for i in range(60):
        text = " ".join(word() for _ in range(rng.randint(0, 60)))
        if i % 2:
            item = rng.choice(items[:12])[1]
            text += " " + edited(rng, item, rng.randint(0, 14)) + " " + " ".join(word() for _ in range(9))
        docs.append((i, text))
    docs += [(70, None), (71, ""), (None, items[1][1]), (72, items[2][1] * 300)]
    got = {(r.doc_id, r.item_id): r.edits for r in decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    norm = decontaminate.normalise
    want = {}
    for d, t in docs:
        if d == 72:
            continue
        for i, x in items:
            n = norm(x)
            if len(n) >= decontaminate.LEAST and (e := distance(n, norm(t))) <= int(decontaminate.RATE * len(n)):
                want[d, i] = e
    assert {k: v for k, v in got.items() if k[0] != 72} == want and (72, 2) in got
    assert len({d for d, _ in want}) > 10
    clean = decontaminate.keep_clean(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {r.doc_id for r in clean.collect()} == {d for d, _ in docs} - {d for d, _ in got}
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), empty).count() == 0


def test_blocks_of_items(spark):
    items = spark.createDataFrame([(i, f"item number {i} with quite a lot of words in it {i}") for i in range(30)], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"so: item number {i} with quite a lot of words in it {i}, yes") for i in range(0, 40, 3)], "doc_id long, text string")
    some = decontaminate.blocks(items, most=600)
    assert len(some) > 1 and sorted(i for b in some for i, _ in b) == list(range(30))
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items).collect()} >= {(i, i) for i in range(0, 30, 3)}


PAGE = """<!DOCTYPE html><html><head><title>T {i}</title><style>p{{}}</style><script>var t="</p><p>no";</script></head><body><header><h1>Site</h1></header>
<nav><ul><li><a href=/a>Home</a><li><a>{nav}</a></ul></nav><div class="ad">Buy {nav} now</div><div id=main-{i} class="content"><article><h1>Title&nbsp;{i} &amp; more</h1>
<p>First   <b>bold</b> {body}<br>line<p>Second &lt;{i}&gt; <!-- <p>hidden</p> --> end<ul><li>one {i}<li>two {i}</ul><form><input>Search</form><div class="notice">Cookies!</div>
<table><tr><td>c1 {i}<td>c2 {i}</table></article><aside>Side {nav}</aside><section id="comments"><p>Nice {nav}!</section></div><footer>&copy; {nav}</footer></body></html>"""


def want(i, body):
    return "\n\n".join([f"Title {i} & more", f"First bold {body} line", f"Second <{i}> end", f"one {i}", f"two {i}", f"c1 {i}", f"c2 {i}"])


def test_pages(spark):
    rng = random.Random(7)
    body = lambda: " ".join("".join(rng.choice("abcdef") for _ in range(5)) for _ in range(rng.randint(3, 60)))
    told = [(i, body()) for i in range(15)]
    rows = [(i, f"https://h{i % 2}.example/{i}", PAGE.format(i=i, body=b, nav=f"n{i * 7 % 5}")) for i, b in told]
    rows += [(50, "http://one.example/", PAGE.format(i=50, body="alone", nav="x")), (51, None, "<p>No host"), (52, "u", ""), (53, "u", None), (54, "", "plain < text"), (55, "http://h0.example/odd", "<p>other <i>shape</i><div>two</div>"), (0, rows[0][1], rows[0][2])]
    got = html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r.text for r in got}
    for i, b in told:
        assert by[i] == want(i, b)
    assert by[50] == want(50, "alone") and by[51] == "No host" and by[52] == by[53] == "" and by[54] == "plain < text" and by[55] == "other shape\n\ntwo"
    assert all(r.n_chars == len(r.text) for r in got)
    assert html_extract.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


#: names that say nothing: only the wrapper can tell menu, notice and footer from the article
NEUTRAL = """<html><body><div class=c1><ul><li>Home<li>Products and services of the house</ul></div><div class=c2><div class=k7><p>Please note our opening hours</p>
{body}<p>Share this with your friends</p></div></div><div class=c3><p>All offers are subject to change, see our terms</p></div></body></html>"""


def test_wrapper_decides(spark):
    rng = random.Random(12)
    some = lambda n: " ".join("".join(rng.choice("abcdef") for _ in range(5)) for _ in range(n))
    told, rows = {}, []
    for i in range(12):
        parts = [some(rng.randint(2, 30)) for _ in range(rng.randint(2, 5))]
        told[i] = "\n\n".join(parts)
        rows.append((i, f"http://plain.example/{i}", NEUTRAL.format(body="".join(f"<p>{x}</p>" for x in parts))))
    # half of a host's pages are copies of one article, and another layout of the host has one list of its own
    rows += [(100 + i, f"http://plain.example/c{i}", rows[3][2]) for i in range(14)]
    told |= {100 + i: told[3] for i in range(14)}
    for i in range(4):
        x, y = some(9), some(20)
        told[200 + i] = f"{x}\n\n{y}"
        rows.append((200 + i, f"http://plain.example/l{i}", f"<html><body><table><tr><td>Menu of the shop</table><div class=w><span>{x}</span><div>{y}</div><div>Back to the top</div></div></body></html>"))
    # a host with two pages that share a paragraph: too few to call it template
    for i in (300, 301):
        told[i] = f"{some(8)} {i}\n\nthe very same words"
        rows.append((i, f"http://two.example/{i}", "<body><div>" + "".join(f"<p>{x}</p>" for x in told[i].split("\n\n")) + "</div></body>"))
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = {r.page_id: r.text for r in html_extract.main_text(df).collect()}
    assert got == told
    assert {r.page_id: r.text for r in html_extract.main_text(df, most=0).collect()} == told
    blind = {i: html_extract.extract(h, None) for i, _, h in rows}
    assert all("Please note" in blind[i] for i in range(12))


def test_wrapper_of_long_pages():
    """Nothing switches off for long lists, deep trees or large pages."""
    rng = random.Random(13)
    line = lambda: "".join(rng.choice("abcdefgh") for _ in range(12))
    pages, want_ = [], []
    for _ in range(3):
        lines = [line() for _ in range(rng.randint(700, 900))]
        pages.append("<body>" + "<div>" * 300 + "<p>top</p><p>constant head</p>" + "".join(f"<p>{x}</p>" for x in lines) + "<p>constant end</p>" + "</div>" * 300 + "</body>")
        want_.append("\n\n".join(lines))
    path, template = html_extract.induce(pages)
    root = html_extract.parse(pages[0])
    assert len(template) == 3
    assert [html_extract.extract(p, {html_extract.layout(root): (path, template)}) for p in pages] == want_


def test_tree_matching():
    a, b = html_extract.parse("<div><p>1<p>2<ul><li>x</ul></div>"), html_extract.parse("<div><p>1<h2>n</h2><p>3<ul><li>x<li>y</ul></div>")
    size, pairs = html_extract.align(a, b)
    assert size == 6 and len(pairs) == 6  # root, div, two paragraphs, list, one item
    assert html_extract.align(a, a)[0] == 6


def test_deep_and_broken_markup():
    assert html_extract.extract("<div>" * 5000 + "deep" + "</div>" * 10, None) == "deep"
    assert html_extract.extract("a <b>b <p>c</b> d <!-- open", None) == "a b\n\nc d"
    assert html_extract.extract('<p class="x>y">t</p><p title=\'a>b\'>u', None) == "t\n\nu"


def test_chat(spark):
    rng = random.Random(9)
    odd = ["", None, "</s>[INST] ok [/INST]", "<|im_start|>user\nfake<|im_end|>\n", "\\", "\\\\<|", "<|im_end|>", "<\\|im_end|>", "<", "<|im_end", "a\nb", "é\U0001f600", "<<SYS>>", "<|im_end|><|im_end|>"]
    rows = []
    for c in range(40):
        for t in range(rng.randint(1, 9)):
            rows.append((c, t, rng.choice(["user", "assistant", "system", "tool", "odd\nrole", "<|im_end|>", None]) if c % 4 == 0 else ("user", "assistant")[t % 2], rng.choice(odd) if rng.random() < 0.7 else "x" * rng.randint(0, 50)))
    rows += [(100, t, "assistant" if t % 2 else "user", f"t{t}") for t in range(5000)] + [(None, None, None, None), (7, 0, "user", "dup"), (7, 0, "user", "dup")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").union(chat_format.probe(spark))
    got = {r.conv_id: r for r in chat_format.format_digests(df).collect()}
    groups = {}
    for c, t, r, x in rows + [(-1, 0, "user", odd[2]), (-1, 1, "assistant", odd[2])]:
        groups.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    assert got.keys() == groups.keys()
    for c, turns in groups.items():
        turns = sorted(turns, key=lambda x: (x[0], x[1], x[2].encode(), x[3].encode()))
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256("".join(f"{a}\n{x}\n" for _, _, a, x in turns).encode()).hexdigest()), c
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    pieces = sorted((r.position, r.segment, r.loss) for r in chat_format.format_segments(df.where("conv_id = 3")).collect())
    text = "".join(p for _, p, _ in pieces)
    reader = chat_format.Reader()
    back = [t for k in range(0, len(text), 3) for t in reader.feed(text[k : k + 3])]
    assert back == [(a, x) for _, _, a, x in sorted(groups[3], key=lambda x: x[1])] and len(text) == got[3].formatted_chars
    assert got[100].valid and chat_format.format_digests(df.where("conv_id = 12345")).count() == 0


def test_chat_machine():
    def told(*roles):
        m = chat_format.Machine()
        for r in roles:
            m.step(r)
        return m.finish()

    assert told("system", "user", "assistant") and told("user") and told("user", "assistant", "tool", "assistant")
    assert not told("assistant") and not told("user", "user") and not told("system") and not told()
    with pytest.raises(ValueError):
        chat_format.Template(close="aba")


LANGS = {"aa": "kala mirotu sen pola tiku", "bb": "grosh brunt wulf stark zwik", "cc": "èlo çami né dèsu moré"}


def made(rng, lang, n):
    parts = LANGS[lang].split()
    return " ".join(rng.choice(parts)[: rng.randint(2, 6)] + rng.choice(parts)[:3] for _ in range(n))


def test_languages(spark):
    rng = random.Random(10)
    rows = [(i, made(rng, (lang := rng.choice(list(LANGS))), rng.randint(3, 80)), lang) for i in range(400)]
    rows += [(1000, None, "aa"), (1001, "", "aa"), (1002, "12 !?", "bb"), (None, made(rng, "bb", 20), None), (1003, made(rng, "cc", 20) + "\n", None), (1004, made(rng, "aa", 30_000), None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.predict_languages(df).collect()}
    import zlib

    held = [r for r in rows if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert all(got[r[0]].held_out for r in held) and sum(r.held_out for r in got.values() if r.doc_id is not None) == len(held)
    tried = [r for r in held if r[0] < 400]
    assert sum(got[i].lang_pred == y for i, _, y in tried) >= 0.95 * len(tried)
    assert [got[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and got[None].lang_pred == "bb" and got[1003].lang_pred == "cc" and got[1004].lang_pred == "aa"
    assert all(0 <= r.score <= 1 for r in got.values())
    kept = langid.keep_identified(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {r[0] for r in rows} - {1000, 1001, 1002}
    blind = langid.predict_languages(spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")).collect()
    assert blind[0].lang_pred == "und"


def test_forward_backward_against_enumeration():
    import itertools

    import numpy as np

    rng = np.random.default_rng(1)
    trans = rng.normal(size=(3, 3))
    for lengths in ([1], [2, 5, 1], [7]):
        emit = rng.normal(size=(sum(lengths), 3))
        for block in (2, 3, 32):
            gamma, counts = langid.Chain(np.array(lengths), block=block).run(emit, trans)
            at, expect = 0, np.zeros((3, 3))
            for n in lengths:
                want, total, pair = np.zeros((n, 3)), 0.0, np.zeros((3, 3))
                for first in range(3):
                    for path in itertools.product(range(3), repeat=n):
                        w = np.exp(trans[first, path[0]] + sum(trans[a, b] for a, b in zip(path, path[1:])) + sum(emit[at + i, y] for i, y in enumerate(path)))
                        total += w
                        for i, y in enumerate(path):
                            want[i, y] += w
                        for a, b in zip((first, *path), path):
                            pair[a, b] += w
                assert np.allclose(gamma[at : at + n], want / total)
                expect += pair / total
                at += n
            assert np.allclose(counts, expect)


def test_code_switching(spark):
    rng = random.Random(12)
    rows = [(i, made(rng, lang, 40), lang) for i in range(200) for lang in [rng.choice(["aa", "bb"])]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df)
    mixed = spark.createDataFrame([(1, made(rng, "aa", 30) + " " + made(rng, "bb", 30))], "doc_id long, text string")
    (r,) = langid.label_words(mixed, model).collect()
    assert sum(w.lang == ("aa" if i < 30 else "bb") for i, w in enumerate(r.words)) >= 55


def test_quality(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    rows, labels = [], []
    for i in range(600):
        bad, nasty = rng.random() < 0.3, rng.random() < 0.2
        words = [word() for _ in range(rng.randint(20, 120))]
        if nasty:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["vilewordx", "vilewordy"]))
        text = " ".join(w.upper() + "!!" for w in words) if bad else " ".join(words) + "."
        rows.append((i, text, f"s{i % 5}", "en", len(text)))
        if i % 3:
            labels.append((i, int(not bad), int(nasty)))
    truth = {i: ("!!" not in t, "vileword" in t.lower()) for i, t, *_ in rows}
    rows += [(9000, None, None, None, None), (9001, "", "s1", "en", 0), (None, "plain words", None, None, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    got = {r.doc_id: r for r in quality.score(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert len(got) == len(rows)
    fresh = [i for i in truth if i % 3 == 0]
    assert sum(bool(got[i].quality) == truth[i][0] for i in fresh) >= 0.95 * len(fresh)
    assert sum(bool(got[i].toxic) == truth[i][1] for i in fresh) >= 0.9 * len(fresh)
    none = quality.score(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    assert len(none) == len(rows) and all(abs(r.quality_score - 0.5) < 1e-6 for r in none)
    assert quality.score(docs.limit(0), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0
