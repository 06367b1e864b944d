"""License scans of pages (DataFrame functions only).

Tags that break a line cut a page's text into blocks; tags inside a line go
without a trace, so a link does not cut a notice.  Units are blocks and up to
``PARAGRAPH`` neighbouring blocks together, and the whole text of a page whose
file name says that it is a license file.  Units and license templates are sparse
TF-IDF vectors; a unit's license is the template with the highest cosine, from
``MIN_COSINE`` on.  Document frequencies are those of the templates' words over all
pages; other words weigh like words of no page.

Only units that share a rare word with a template become vectors, which loses
none: a template's rare words are those of the fewest pages, as many as it takes
that the others together are too light for a cosine of ``MIN_COSINE``.

A page without a license of its own inherits from the nearest ancestor
directory that has one: a directory's license is that of its license files and
index pages (best score, then smallest id).  The ancestors of a page are the
prefixes of its path, joined to the directories by equality, so nothing is
compared pair by pair.  The template table and its vocabulary are constants of
this module and are broadcast; what grows with the pages never is.

Cases: rows with equal page_id and url count as one page; a null url has no
path and inherits nothing; null or empty html has no unit; character references
count as blanks; ties between templates go to the smaller name; a very long page
is one row with its words; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import store

MIN_COSINE = 0.6

#: Public notices of common licenses, short and whole.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work. CC0 1.0 Universal"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    # What the full texts of licenses are headed by.
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International Public License"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International Public License"),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International Public License"),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
    ("GPL-1.0", "GNU GENERAL PUBLIC LICENSE Version 1, February 1989"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.0", "GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("MPL-1.1", "Mozilla Public License Version 1.1"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
]
#: Neighbouring blocks that are scored together, at most.
PARAGRAPH = 3
LICENSE_FILE = r"(?i)^(un)?(licen[cs]e|copying|notice)([._-].*)?$"
INDEX_FILE = r"(?i)^(index\.[a-z]+)?$"
WORD = "[a-z0-9]+"

#: What stands for each kind of markup; elements that do not break a line leave nothing.
_MARKUP = [
    (r"(?is)<script\b[^>]*>.*?</script>", "\n"),
    (r"(?is)<style\b[^>]*>.*?</style>", "\n"),
    (r"(?s)<!--.*?-->", ""),
    (r"(?i)</?(a|abbr|acronym|b|bdi|bdo|big|cite|code|data|del|dfn|em|font|i|ins|kbd|label|mark|q|s|samp|small|span|strike|strong|sub|sup|time|tt|u|var|wbr)(\s[^>]*)?/?>", ""),
    ("<[^>]*>", "\n"),
    ("(?i)&(#[0-9]+|#x[0-9a-f]+|[a-z][a-z0-9]*);", " "),
]
_PAGE = ["page_id", "url"]


def _table(df: DataFrame, rows: list[Column]) -> DataFrame:
    return df.sparkSession.range(1).select(F.inline(F.array(*rows)))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def parse(pages: DataFrame) -> DataFrame:
    """page_id, url, directory (host and folders, with the last slash), name, body (text by lines)."""
    body = F.coalesce(F.col("html").cast("string"), F.lit(""))
    for pattern, instead in _MARKUP:
        body = F.regexp_replace(body, pattern, instead)
    place = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^?#]*)", 1)
    place = F.when(place.contains("/"), place).when(place != "", F.concat(place, F.lit("/")))
    return pages.select("page_id", "url", place.alias("_place"), body.alias("body")).select(*_PAGE, F.regexp_extract("_place", "^.*/", 0).alias("directory"), F.regexp_extract("_place", "[^/]*$", 0).alias("name"), "body")


def _vocabulary(templates: list[tuple[str, str]]) -> list[str]:
    import re

    return sorted({w for _, text in templates for w in re.findall(WORD, text.lower())})


def document_frequencies(parsed: DataFrame, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """token and idf of each word of the templates, over all pages; one row per word."""
    vocabulary = _vocabulary(templates)
    known = F.array(*[F.lit(w) for w in vocabulary])
    counted = parsed.select(F.explode(F.array_intersect(words(F.col("body")), known)).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    total = parsed.agg(F.count("*").alias("n_pages"))
    every = _table(parsed, [F.struct(F.lit(w).alias("token")) for w in vocabulary])
    return every.join(F.broadcast(counted), "token", "left").crossJoin(F.broadcast(total)).select("token", (F.log((F.col("n_pages") + 1) / (F.coalesce("n", F.lit(0)) + 1)) + 1).alias("idf"), (F.log(F.col("n_pages") + 1) + 1).alias("rarest"))


def template_vectors(idf: DataFrame, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """token, template, license, weight: unit vectors of the templates."""
    rows = _table(idf, [F.struct(F.lit(i).alias("template"), F.lit(n).alias("license"), F.lit(t).alias("text")) for i, (n, t) in enumerate(templates)])
    tf = rows.select("template", "license", F.explode(words(F.col("text"))).alias("token")).groupBy("template", "license", "token").agg(F.count("*").alias("tf"))
    weighed = tf.join(F.broadcast(idf), "token").withColumn("w", F.col("tf") * F.col("idf"))
    return weighed.select("token", "template", "license", (F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("template")))).alias("weight"))


def rare_words(vectors: DataFrame, idf: DataFrame, least: float = MIN_COSINE) -> DataFrame:
    """One row, ``rare``: each template's rarest words, until the rest weighs less than ``least``."""
    order = Window.partitionBy("template").orderBy(F.desc("idf"), "token").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.col("weight") * F.col("weight")).over(order), F.lit(0.0))
    ranked = vectors.join(F.broadcast(idf.select("token", "idf")), "token").withColumn("before", before)
    return ranked.filter(F.col("before") <= 1 - least * least + 1e-6).agg(F.collect_set("token").alias("rare"))


def headers(parsed: DataFrame, rare: DataFrame) -> DataFrame:
    """page, unit number and words of each unit that has a rare word; ``rare`` is the row of ``rare_words``."""
    blocks = F.filter(F.transform(F.split("body", "\n"), words), lambda b: F.size(b) > 0)
    cut = parsed.select(*_PAGE, "name", blocks.alias("blocks"))
    span = lambda n: F.transform("blocks", lambda _, at: F.flatten(F.slice("blocks", at + 1, F.lit(n))))
    near = F.exists("blocks", lambda b: F.arrays_overlap(b, F.col("rare")))
    hit = lambda unit: F.arrays_overlap(unit, F.col("rare"))
    whole = F.when(F.col("name").rlike(LICENSE_FILE), F.array(F.flatten("blocks"))).otherwise(F.array())
    units = F.filter(F.array_distinct(F.concat(whole, *[span(n) for n in range(1, PARAGRAPH + 1)])), hit)
    return cut.crossJoin(F.broadcast(rare)).filter(near).select(*_PAGE, F.posexplode(units).alias("unit", "words"))


def own_licenses(units: DataFrame, idf: DataFrame, vectors: DataFrame, least: float = MIN_COSINE) -> DataFrame:
    """page, license, score: the best template of any unit of the page; ``vectors`` are the templates'."""
    tf = units.select(*_PAGE, "unit", F.explode("words").alias("token")).groupBy(*_PAGE, "unit", "token").agg(F.count("*").alias("tf"))
    rarest = idf.select("rarest").limit(1)
    weighed = tf.join(F.broadcast(idf.select("token", "idf")), "token", "left").crossJoin(F.broadcast(rarest)).withColumn("w", F.col("tf") * F.coalesce("idf", "rarest"))
    hits = F.collect_list(F.when(F.col("idf").isNotNull(), F.struct("token", "w")))
    each = weighed.groupBy(*_PAGE, "unit").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"), hits.alias("hits"))
    matched = each.select(*_PAGE, "unit", "length", F.inline("hits")).join(F.broadcast(vectors), "token").groupBy(*_PAGE, "unit", "template", "license").agg(F.round(F.sum(F.col("w") * F.col("weight")) / F.first("length"), 4).alias("score"))
    best = F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("b")
    return matched.filter(F.col("score") >= least).groupBy(*_PAGE).agg(best).select(*_PAGE, F.col("b.license").alias("license"), (-F.col("b.s")).alias("score"))


def scan(pages: DataFrame, least: float = MIN_COSINE, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """One row per page: license, how it is known (own, inherited, none), score, from_page, from_directory."""
    parsed = store(parse(pages), "license-pages")
    idf = store(document_frequencies(parsed, templates), "license-words")
    vectors = template_vectors(idf, templates)
    own = own_licenses(headers(parsed, rare_words(vectors, idf, least)), idf, vectors, least)
    none = F.lit(None)
    places = parsed.select(*_PAGE, "directory", "name", none.cast("string").alias("license"), none.cast("double").alias("score"))
    merged = places.unionByName(own, allowMissingColumns=True).groupBy(*_PAGE).agg(F.max("directory").alias("directory"), F.max("name").alias("name"), F.max("license").alias("license"), F.max("score").alias("score"))
    notices = merged.filter(F.col("license").isNotNull() & F.col("directory").isNotNull() & (F.col("name").rlike(LICENSE_FILE) | F.col("name").rlike(INDEX_FILE)))
    directories = notices.groupBy(F.col("directory").alias("folder")).agg(F.min(F.struct((-F.col("score")).alias("s"), "page_id", "license")).alias("n"))
    parts = F.split("directory", "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.concat(F.array_join(F.slice(parts, F.lit(1), k), "/"), F.lit("/")))
    lacking = merged.filter(F.col("license").isNull() & F.col("directory").isNotNull()).select(*_PAGE, F.explode(ancestors).alias("folder"))
    nearest = F.max(F.struct(F.length("folder").alias("depth"), "folder", "n")).alias("a")
    inherited = lacking.join(directories, "folder").groupBy(*_PAGE).agg(nearest).select(*_PAGE, F.col("a.n.license").alias("license"), (-F.col("a.n.s")).alias("score"), F.col("a.n.page_id").alias("from_page"), F.col("a.folder").alias("from_directory"))
    every = merged.select(*_PAGE, "license", "score", F.when(F.col("license").isNotNull(), F.col("page_id")).alias("from_page"), none.cast("string").alias("from_directory")).unionByName(inherited)
    out = every.groupBy(*_PAGE).agg(*[F.max(c).alias(c) for c in ("license", "score", "from_page", "from_directory")])
    how = F.when(F.col("license").isNull(), "none").when(F.col("from_directory").isNotNull(), "inherited").otherwise("own")
    return out.withColumn("relation", how)


def op6_license(pages: DataFrame) -> DataFrame:
    """All pages with their license, as ``OP6_SQL`` defines it."""
    return scan(pages).select("page_id", "url", "license", "relation", "score", "from_page", "from_directory")


def _values() -> str:
    return ", ".join(f"({i}, '{n}', '{t}')" for i, (n, t) in enumerate(TEMPLATES))


def _stripped() -> str:
    body = "coalesce(html, '')"
    for pattern, instead in _MARKUP:
        body = f"regexp_replace({body}, '{pattern}', {'chr(10)' if instead == chr(10) else repr(instead)}, 'g')"
    return body


OP6_SQL = f"""
WITH templates(template, license, text) AS (VALUES {_values()}),
p AS (
  SELECT page_id, url, {_stripped()} AS body,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^?#]*)', 1) AS place0 FROM pages),
q AS (SELECT page_id, url, body, CASE WHEN contains(place0, '/') THEN place0 WHEN place0 <> '' THEN place0 || '/' END AS place FROM p),
parsed AS (SELECT *, regexp_extract(place, '^.*/') AS directory, regexp_extract(place, '[^/]*$') AS name FROM q),
tt AS (SELECT template, license, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM templates),
ttf AS (SELECT template, license, token, count(*) AS tf FROM tt GROUP BY ALL),
df AS (SELECT token, count(*) AS n FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(body), '[a-z0-9]+'))) AS token FROM parsed) WHERE token IN (SELECT token FROM ttf) GROUP BY token),
total AS (SELECT count(*) AS n_pages FROM parsed),
idf AS (SELECT v.token, ln((n_pages + 1) / (coalesce(n, 0) + 1)) + 1 AS idf FROM (SELECT DISTINCT token FROM ttf) v LEFT JOIN df USING (token), total),
tw AS (SELECT token, template, license, tf * idf AS w FROM ttf JOIN idf USING (token)),
tv AS (SELECT token, template, license, w / sqrt(sum(w * w) OVER (PARTITION BY template)) AS weight FROM tw),
blocks AS (
  SELECT page_id, url, name, list_filter(list_transform(string_split(body, chr(10)), lambda x: regexp_extract_all(lower(x), '[a-z0-9]+')), lambda x: len(x) > 0) AS b FROM parsed),
known AS (SELECT list(DISTINCT token) AS k FROM ttf),
units AS (
  SELECT page_id, url, unnest(list_filter(list_concat(CASE WHEN regexp_matches(name, '{LICENSE_FILE}') THEN [flatten(b)] ELSE [] END,
    flatten(list_transform(range(1, {PARAGRAPH} + 1), lambda n: list_transform(range(1, len(b) + 1), lambda i: flatten(b[i:i + n - 1]))))),
    lambda x: list_has_any(x, k))) AS words FROM blocks, known),
numbered AS (SELECT *, row_number() OVER () AS unit FROM units),
uw AS (SELECT page_id, url, unit, unnest(words) AS token FROM numbered),
utf AS (SELECT page_id, url, unit, token, count(*) AS tf FROM uw GROUP BY ALL),
uv AS (SELECT u.*, idf.idf IS NOT NULL AS hit, tf * coalesce(idf.idf, ln(n_pages + 1) + 1) AS w FROM utf u LEFT JOIN idf USING (token), total),
len AS (SELECT unit, sqrt(sum(w * w)) AS length FROM uv GROUP BY unit),
matched AS (SELECT page_id, url, unit, template, license, round(sum(w * weight) / any_value(length), 4) AS score
  FROM uv JOIN tv USING (token) JOIN len USING (unit) GROUP BY page_id, url, unit, template, license),
own AS (SELECT page_id, url, license, score FROM matched WHERE score >= {MIN_COSINE}
  QUALIFY row_number() OVER (PARTITION BY page_id, url ORDER BY score DESC, license) = 1),
merged AS (SELECT DISTINCT p.page_id, p.url, directory, name, license, score FROM parsed p LEFT JOIN own o ON p.page_id IS NOT DISTINCT FROM o.page_id AND p.url IS NOT DISTINCT FROM o.url),
dirs AS (SELECT directory AS folder, license, score, page_id AS from_page FROM merged WHERE license IS NOT NULL AND directory IS NOT NULL
  AND (regexp_matches(name, '{LICENSE_FILE}') OR regexp_matches(name, '{INDEX_FILE}'))
  QUALIFY row_number() OVER (PARTITION BY directory ORDER BY score DESC, page_id) = 1),
inh AS (SELECT m.page_id, m.url, d.* FROM merged m JOIN dirs d ON m.license IS NULL AND starts_with(m.directory, d.folder)
  QUALIFY row_number() OVER (PARTITION BY m.page_id, m.url ORDER BY length(d.folder) DESC) = 1)
SELECT m.page_id, m.url, coalesce(m.license, i.license) AS license,
  CASE WHEN m.license IS NOT NULL THEN 'own' WHEN i.license IS NOT NULL THEN 'inherited' ELSE 'none' END AS relation,
  coalesce(m.score, i.score) AS score, CASE WHEN m.license IS NOT NULL THEN m.page_id ELSE i.from_page END AS from_page, i.folder AS from_directory
FROM merged m LEFT JOIN inh i ON m.page_id IS NOT DISTINCT FROM i.page_id AND m.url IS NOT DISTINCT FROM i.url
"""
