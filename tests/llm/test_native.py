"""Mixing, URL filters and licence scans: SQL twins, edge cases and small brute force."""

import duckdb
import pytest

from tessellane.llm import licenses, mixing, urls

DOCS = "doc_id long, text string, source string"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def twin(sql, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(f"{name}_df", df.toPandas())
        con.execute(f"create table {name} as select * from {name}_df")
    return con.execute(sql)


@pytest.fixture(scope="module")
def docs(spark):
    made = [(i, "word " * (i % 17), f"s{i % 5}" if i % 3 else "s0") for i in range(400)]
    made += [(1000, None, None), (1001, "", "s1"), (None, "a b c", None), (5, "word " * 5, "s0"), (5, "word " * 5, "s0"), (1002, "x\u00a0y \t\n\r z\x0b\x0cq", "ß")]
    made += [(2000 + i, "long " * 3000, "huge") for i in range(3)]
    return spark.createDataFrame(made, DOCS)


def test_mix_equals_sql(docs):
    ours = mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")
    assert rows(ours) == sorted(map(tuple, [[None if x != x else x for x in r] for r in twin(mixing.ORACLE, documents=docs.withColumn("doc_id", docs.doc_id.cast("long"))).fetchall()]), key=str)


def test_mix_reaches_targets(docs):
    out = mixing.mix(docs).toPandas()
    for _, part in out.groupby(out.source.fillna("null!")):
        assert part.taken.sum() == int(part.target.iloc[0])
        assert (part.taken <= 2 * part["size"]).all()
    assert abs(out.taken.sum() - 1.5 * out["size"].sum()) < 10
    assert rows(mixing.mix(docs)) == rows(mixing.mix(docs.repartition(7)))


def test_mix_empty_and_clashing(spark):
    empty = spark.createDataFrame([], DOCS)
    assert mixing.mix(empty).count() == 0
    clash = spark.createDataFrame([(1, "a b", "s", 9, "k", 3)], DOCS + ", size int, key string, target int")
    assert [(r.size, r.taken) for r in mixing.mix(clash).select("size", "taken").collect()] == [(2, 3)]
    only = spark.createDataFrame([(1, None, None), (2, "", None)], DOCS)
    assert [r.taken for r in mixing.mix(only).collect()] == [0, 0]


def test_mix_spreads_rows_without_ids(spark):
    docs = spark.createDataFrame([(None, f"text number {i}", "s") for i in range(600)], DOCS)
    assert mixing._keyed(docs, "mix").select("range").distinct().count() > 400
    assert mixing.mix(docs).agg({"taken": "sum"}).first()[0] == int(1.5 * 1800)


def brute_url(url, rules):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.index(c) for c in "?#" if c in path], default=len(path))]
    fit = [(len(h + p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return (host, path, best[2], best[3]) if best else (host, path, None, "allow")


def test_urls_equal_brute_force(spark):
    rules = [*urls.RULES, ("block", "a.b.com", "/x"), ("allow", "b.com", "/x/y"), ("block", "b.com", "/x/y/zz"), ("allow", "com", "/"), ("block", "b.com", "/x")]
    paths = ["", "/", "/en/", "/en/7", "/en/70/a", "/de/8", "/de/9?x=1", "/es/#t", "/x", "/x/y", "/x/y/z", "/x/y/zz/1", "/x/yy", "/X", "/é"]
    hosts = ["com", "Example.com", "a.b.com", "xb.com", "b.com", "net", "sub.example.net", "notnet", "org", "", "COM.", "a..com"]
    made = [(i, f"http{'s' if i % 2 else ''}://{h}{p}") for i, (h, p) in enumerate((h, p) for h in hosts for p in paths)]
    made += [(9000, None), (9001, ""), (9002, "no scheme"), (9003, "a://b://c/d"), (0, made[0][1]), (9004, "x://com/en/" + "a" * 5000)]
    pages = spark.createDataFrame(made, "page_id long, url string")
    got = rows(urls.judge(pages, urls.rule_table(spark, rules)))
    assert got == sorted(((i, *brute_url(u, rules)) for i, u in made), key=str)


def test_urls_many_sweeps_and_empty(spark, monkeypatch):
    monkeypatch.setattr(urls, "SWEEP_ROWS", 7)
    made = [(i, f"http://h{i % 3}.com/en/{i % 50}") for i in range(100)]
    pages = spark.createDataFrame([(i, u, "rule", "host") for i, u in made], "page_id long, url string, rule string, host string")
    assert rows(urls.judge(pages, urls.rule_table(spark))) == sorted(((i, *brute_url(u, urls.RULES)) for i, u in made), key=str)
    assert urls.judge(pages.limit(0), urls.rule_table(spark)).count() == 0
    assert {r.verdict for r in urls.judge(pages, urls.rule_table(spark).limit(0)).collect()} == {"allow"}


def test_urls_of_many_nested_rules_and_ranges(spark, monkeypatch):
    import random

    monkeypatch.setattr(urls, "SWEEP_ROWS", 5)
    rng = random.Random(3)
    path = lambda: "/" + "/".join(rng.choice("abc") * rng.randrange(3) for _ in range(rng.randrange(4)))
    host = lambda: ".".join(rng.choice(["a", "b", "com", "org", "x-y"]) for _ in range(rng.randrange(1, 4)))
    rules = list({(h, p): (rng.choice(["block", "allow"]), h, p) for h, p in ((host(), path()) for _ in range(120))}.values())
    made = [(i, f"http://{host()}{path()}") for i in range(300)]
    got = rows(urls.judge(spark.createDataFrame(made, "page_id long, url string"), urls.rule_table(spark, rules)))
    assert got == sorted(((i, *brute_url(u, rules)) for i, u in made), key=str)


def test_licences(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction."
    made = [
        (1, "Words. Licensed under the Apache License, Version 2.0. More."),
        (2, "Released under the MIT License.\nLicensed under CC BY-NC 4.0.\nReleased under the MIT License."),
        (3, "licensed under the APACHE license version 2.0\nYou may not use this file except in compliance with the License. You may obtain a copy of the License at\nx\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
        (4, mit), (5, None), (6, ""), (7, "Nothing here. " * 3000), (2, "Released under the MIT License."),
    ]
    docs = spark.createDataFrame([(*r, "x") for r in made], "doc_id long, text string, ids string")
    got = rows(licenses.scan(docs))
    assert (1, 1, "ap1", "apache-2.0.notice", "Apache-2.0") in got
    assert (2, 3, "mi1,cc1,mi1", "mit.notice,cc-by-nc-4.0.notice", "CC-BY-NC-4.0,MIT") in got
    assert (3, 4, "ap1,ap2,ap3,ap4", "apache-2.0.header", "Apache-2.0") in got
    assert (5, 0, "", "", "") in got and (7, 0, "", "", "") in got
    assert got == sorted(map(tuple, twin(licenses.oracle(), documents=docs).fetchall()), key=str)
    assert licenses.scan(docs.limit(0)).count() == 0


MIT = """Copyright (c) 2020 Some One

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
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
APACHE = """   Copyright 2020 Some One

   Licensed under the Apache License, Version 2.0 (the "License");
   you may not use this file except in compliance with the License.
   You may obtain a copy of the License at

       http://www.apache.org/licenses/LICENSE-2.0

   Unless required by applicable law or agreed to in writing, software
   distributed under the License is distributed on an "AS IS" BASIS,
   WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
   See the License for the specific language governing permissions and
   limitations under the License.
"""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>.
"""
BSD = """Copyright (c) 2020, Some One
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
"""


def test_wrapped_licence_texts(spark):
    unwrap = lambda t: "\n\n".join(" ".join(p.split()) for p in t.split("\n\n"))
    comment = "/*\n" + "".join(f" * {line}\n" for line in APACHE.splitlines()) + " */\nint main() {}"
    made = [
        (1, MIT), (2, APACHE), (3, GPL), (4, BSD), (5, MIT.replace("\n", "\r\n")), (6, comment), (7, BSD.replace("1. ", "(1) ").replace("2. ", "(2) ")),
        (8, unwrap(MIT)), (9, unwrap(APACHE)), (10, "Released under\n\nthe MIT License."), (11, "Released under\nthe MIT License.\nMore"), (12, "Not released under the MIT License."),
    ]
    docs = spark.createDataFrame(made, "doc_id long, text string")
    got = {r.doc_id: (r.sentence_ids, r.rules, r.licenses) for r in licenses.scan(docs).collect()}
    assert rows(licenses.scan(docs)) == sorted(map(tuple, twin(licenses.oracle(), documents=docs).fetchall()), key=str)
    mit, apache, bsd = ("mi2,mi3,mi4", "mit.text", "MIT"), ("ap5,ap3,ap4", "apache-2.0.header", "Apache-2.0"), ("ar1,bs1,bs2,bs3", "bsd-2-clause.text", "BSD-2-Clause")
    assert got[1] == got[5] == mit and got[2] == got[6] == apache and got[4] == got[7] == bsd
    assert got[3] == ("gp3,gp4,gp5", "gpl-3.0.header", "GPL-3.0-or-later")
    assert got[8] == mit and got[9] == apache
    assert got[10] == got[12] == ("", "", "") and got[11] == ("mi1", "mit.notice", "MIT")


#: As they stand in the heads of files.
HEADERS = {
    "GPL-2.0-or-later": """This program is free software; you can redistribute it and/or
modify it under the terms of the GNU General Public License
as published by the Free Software Foundation; either version 2
of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program; if not, write to the Free Software
Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA  02110-1301, USA.""",
    "GPL-2.0-only": """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License version 2 as
published by the Free Software Foundation.""",
    "LGPL-2.1-or-later": """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.

This library is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
Lesser General Public License for more details.""",
    "AGPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU Affero General Public License as published
by the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU Affero General Public License for more details.

You should have received a copy of the GNU Affero General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR""",
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means.""",
    "CC0-1.0": """To the extent possible under law, the author(s) have dedicated all copyright
and related and neighboring rights to this software to the public domain
worldwide. This software is distributed without any warranty.""",
    "Zlib": """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented.""",
    "EPL-2.0": """This program and the accompanying materials are made
available under the terms of the Eclipse Public License 2.0
which is available at https://www.eclipse.org/legal/epl-2.0/

SPDX-License-Identifier: EPL-2.0""",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.\n(See accompanying file LICENSE_1_0.txt)",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0\nInternational License.",
}


def test_every_sentence_alone_is_found(spark):
    made = [(k, s.upper()) for k, (_, s) in enumerate(licenses.SENTENCES)]
    got = {r.doc_id: r.sentence_ids for r in licenses.scan(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    assert got == {k: i for k, (i, _) in enumerate(licenses.SENTENCES)}
    needed = licenses._needed_words({s for _, s in licenses.SENTENCES})
    assert len(needed) < 15 and all(any(w in s for w in needed) for _, s in licenses.SENTENCES)


def test_headers_of_many_licences(spark):
    shapes = [lambda t: t, lambda t: "\n".join(f"# {x}".rstrip() for x in t.split("\n")), lambda t: "/*\n" + "\n".join(f" * {x}" for x in t.split("\n")) + "\n */\n", lambda t: "Some words before.\n\n" + t + "\n\nMore words after."]
    shapes.append(lambda t: "\n\n".join(" ".join(p.split()) for p in t.split("\n\n")))
    made = [(i, k, shape(t)) for i, (k, t, shape) in enumerate((k, t, shape) for k, t in HEADERS.items() for shape in shapes)]
    docs = spark.createDataFrame([(i, t) for i, _, t in made], "doc_id long, text string")
    got = {r.doc_id: r.licenses for r in licenses.scan(docs).collect()}
    assert got == {i: k for i, k, _ in made}
    assert rows(licenses.scan(docs)) == sorted(map(tuple, twin(licenses.oracle(), documents=docs).fetchall()), key=str)
