import random

from prosemill.llm import license_scan

PAGE = "page_id long, url string, html string"


def scan(spark, rows):
    return {r.page_id: r for r in license_scan.scan(spark.createDataFrame(rows, PAGE).repartition(3)).collect()}


def test_own_file_and_inherited(spark):
    rows = [
        (1, "https://a.org/p/LICENSE", "<p>Released under the MIT License.</p>"),
        (2, "https://a.org/p/q/x.html", "<p>plain text</p>"),
        (3, "https://a.org/p/q/y.html?z=1", "<h1>Licensed under the Apache License, Version 2.0.</h1><p>more"),
        (4, "https://a.org/other.html", "<p>nothing</p>"),
        (5, "https://a.org/p/q/", "<p>This work is licensed under the GNU General Public License, version 3.</p>"),
        (6, "https://a.org/p/q/r/s.html", "text"),
        (7, "https://b.org/p/q/x.html", "text"),
    ]
    got = scan(spark, rows)
    assert {k: (v.license, v.relation, v.from_page, v.from_directory) for k, v in got.items()} == {
        1: ("MIT", "own", 1, None),
        2: ("GPL-3.0", "inherited", 5, "a.org/p/q/"),
        3: ("Apache-2.0", "own", 3, None),
        4: (None, "none", None, None),
        5: ("GPL-3.0", "own", 5, None),
        6: ("GPL-3.0", "inherited", 5, "a.org/p/q/"),
        7: (None, "none", None, None),
    }
    assert got[1].score > 0.99


def test_markup_is_not_a_header(spark):
    got = scan(spark, [(1, "http://x.net/a", "<script>Released under the MIT License.</script><!-- Licensed under CC BY 4.0. --><p>hi</p>"), (2, "http://x.net/b", "<b>a license to do many other things that no template says</b>")])
    assert [got[k].relation for k in (1, 2)] == ["none", "none"]


def test_odd_rows(spark):
    rows = [(1, None, "Licensed under CC BY-NC 4.0."), (2, "nonsense", None), (None, "http://h.org", ""), (3, "http://h.org/", "Licensed under CC BY-SA 4.0."), (3, "http://h.org/", "Licensed under CC BY-SA 4.0."), (4, "http://h.org/x", None)]
    frame = spark.createDataFrame(rows, PAGE).selectExpr("*", "'t' AS license", "1 AS score")
    got = sorted(((r.page_id, r.url, r.license, r.relation) for r in license_scan.op6_license(frame).collect()), key=repr)
    assert got == sorted([(1, None, "CC-BY-NC-4.0", "own"), (2, "nonsense", None, "none"), (None, "http://h.org", "CC-BY-SA-4.0", "inherited"), (3, "http://h.org/", "CC-BY-SA-4.0", "own"), (4, "http://h.org/x", "CC-BY-SA-4.0", "inherited")], key=repr)
    assert license_scan.op6_license(frame.limit(0)).collect() == []


def test_no_python_in_the_plan(spark):
    plan = license_scan.op6_license(spark.createDataFrame([(1, "http://x.net/a", "x")], PAGE))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


MIT = """MIT License

Copyright (c) 2020 Some One

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
GPL = """                    GNU GENERAL PUBLIC LICENSE
                       Version {}

 Copyright (C) Free Software Foundation, Inc.
 Everyone is permitted to copy and distribute verbatim copies
 of this license document, but changing it is not allowed.

  If this is what you want to do, use the GNU Lesser General Public License
instead of this License.
"""


def test_full_texts_of_license_files(spark):
    rows = [(1, "https://a.org/m/LICENSE", MIT), (2, "https://a.org/m/x/y.html", "plain"), (3, "https://a.org/g3/COPYING", GPL.format("3, 29 June 2007")), (4, "https://a.org/g2/COPYING.txt", GPL.format("2, June 1991")), (5, "https://a.org/n/LICENSE", "All rights reserved. No license is given to anyone.")]
    got = scan(spark, rows)
    assert {k: (v.license, v.relation) for k, v in got.items()} == {1: ("MIT", "own"), 2: ("MIT", "inherited"), 3: ("GPL-3.0", "own"), 4: ("GPL-2.0", "own"), 5: (None, "none")}


def test_links_and_wrapped_lines(spark):
    rows = [
        (1, "https://a.org/1", "<p>Licensed under <a href='x'>CC BY 4.0</a>.</p>"),
        (2, "https://a.org/2", "<div>Licensed under the <a>Apache License</a>,<span> Version 2.0</span>.</div>"),
        (3, "https://a.org/3", f"<h1>Some code</h1><pre>{MIT}</pre><p>and more text about it</p>"),
        (4, "https://a.org/4", "<p>&copy; 2020 Some&nbsp;One.</p><p>Released under the MIT&nbsp;License.</p>"),
        (5, "https://a.org/5", "<p>This work is<br>licensed under the GNU General<br/>Public License, version&#32;3.</p>"),
        (6, "https://a.org/6", "<p>The licence of this shop is a matter of copyright law in general.</p>"),
    ]
    got = scan(spark, rows)
    assert {k: v.license for k, v in got.items()} == {1: "CC-BY-4.0", 2: "Apache-2.0", 3: "MIT", 4: "MIT", 5: "GPL-3.0", 6: None}


def test_rare_words_lose_no_unit(spark):
    """Every unit of all pages, without the filter, has the same best template."""
    rng = random.Random(3)
    vocabulary = license_scan._vocabulary(license_scan.TEMPLATES) + ["zebra", "quilt", "lamp"]
    notices = [t for _, t in license_scan.TEMPLATES]
    rows = []
    for i in range(60):
        notice = rng.choice(notices).split()
        some = [w for w in notice if rng.random() < 0.7]
        rows.append((i, f"https://h.org/{i % 7}/p{i}", f"<p>{' '.join(rng.choices(vocabulary, k=12))}</p><p>{' '.join(some)}</p><p>{' '.join(rng.choices(vocabulary, k=5))}</p>"))
    parsed = license_scan.parse(spark.createDataFrame(rows, PAGE)).cache()
    idf = license_scan.document_frequencies(parsed)
    vectors = license_scan.template_vectors(idf)
    every = spark.createDataFrame([(vocabulary,)], "rare array<string>")
    few, all_ = (sorted((r.page_id, r.license, r.score) for r in license_scan.own_licenses(license_scan.headers(parsed, rare), idf, vectors).collect()) for rare in (license_scan.rare_words(vectors, idf), every))
    assert few == all_ and len(few) > 30
    assert not {"zebra", "quilt", "lamp"} & set(license_scan.rare_words(vectors, idf).first().rare)


def test_long_page(spark):
    body = "<p>plain words of a long page</p>" * 60_000
    got = scan(spark, [(1, "https://a.org/x", body + "<p>Released under the MIT License.</p>" + body), (2, "https://a.org/LICENSE", "word " * 300_000)])
    assert got[1].license == "MIT" and got[2].license is None
