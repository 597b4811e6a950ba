"""License scans: Dice coefficient over word bigrams against licence templates.

A unit of text is a window of as many word bigrams as a template has, starting
with one of them, anywhere in the whole text; lines do not matter. With distinct
bigrams counted, a coefficient of at least t between n and m bigrams needs
min(n, m) >= t / (2 - t) * max(n, m) common ones at the least. These bounds prune
in three steps: texts without any of a few words that every possible match must
hold; texts with too few of a template's bigrams; windows with too few of them.
All expressions are built in.
"""

from __future__ import annotations

import math
import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import let, stored

THRESHOLD = 0.8
_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_BSD_1 = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_GNU = "This {0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1} as published by the Free Software Foundation, either version {2} of the License, or (at your option) any later version. This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1} for more details."
# Licence names with whole licence texts, the notices by which the
# long ones are applied, and short notices.
TEMPLATES = (
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. " + _AS_IS),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + _AS_IS),
    ("BSD-2-Clause", _BSD_1 + _BSD_END),
    ("BSD-3-Clause", _BSD_1 + _BSD_3 + _BSD_END),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("GPL-2.0", _GNU.format("program", "General Public License", "2")),
    ("GPL-3.0", _GNU.format("program", "General Public License", "3")),
    ("LGPL-2.1", _GNU.format("library", "Lesser General Public License", "2.1")),
    ("LGPL-3.0", _GNU.format("library", "Lesser General Public License", "3")),
    ("AGPL-3.0", _GNU.format("program", "Affero General Public License", "3")),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
)


def words(low: Column) -> Column:
    """Words of letters and digits of a lower-cased text."""
    return F.array_remove(F.split(low, "[^\\p{L}\\p{N}]+"), "")


def _words(text: str) -> list[str]:
    return [x for x in re.split(r"[\W_]+", text.lower()) if x]


def _plain(text: str) -> list[str]:
    w = _words(text)
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(w, w[1:])))


def key_words(templates=TEMPLATES, threshold: float = THRESHOLD) -> list[str]:
    """Words of which every text with a match holds one: a match lacks at most
    m - ceil(bound * m) of a template's m bigrams, and more of them than that
    hold a key word. The words that serve most templates are taken first."""
    need = {}
    for k, (_, text) in enumerate(templates):
        grams = _plain(text)
        need[k] = (grams, len(grams) - math.ceil(threshold / (2 - threshold) * len(grams)) + 1)
    chosen: list[str] = []
    while True:
        gain: dict[str, int] = {}
        for grams, least in need.values():
            open_ = [g for g in grams if not set(g.split()) & set(chosen)]
            left = least - (len(grams) - len(open_))
            if left > 0:
                for w in {x for g in open_ for x in g.split()}:
                    # the longer a word, the fewer texts hold it
                    gain[w] = gain.get(w, 0) + min(left, sum(w in g.split() for g in open_)) * len(w) ** 3
        if not gain:
            return chosen
        chosen.append(min(gain, key=lambda w: (-gain[w], w)))


def template_table(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """(template, license, size, span, bigram) of a fixed list of templates:
    size counts distinct bigrams, span all of them."""
    rows = [(i, name, len(grams), len(_words(text)) - 1, g) for i, (name, text) in enumerate(templates) for grams in [_plain(text)] for g in grams]
    return spark.createDataFrame(rows, "template int, license string, size int, span int, bigram string")


def scan_licenses(docs: DataFrame, threshold: float = THRESHOLD, templates=TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_matches, license, score, matches`` of every whole text.

    A template's windows of at least ``threshold`` whose starts are half its
    length apart at most are one match, of the best score, then the earliest;
    a match goes if another one that overlaps it is better: of higher score,
    then longer, then earlier, then of the lesser template. n_matches counts
    what is left; license and score are those of the best; matches lists
    (start, end, license, score) in words, end exclusive.

    Null, empty and one-word texts match nothing. Repeated documents, and null
    ids, each give a row. Other columns are ignored, whatever their names.
    """
    bound = threshold / (2 - threshold)
    low = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    keys = key_words(templates, threshold)
    short = "|".join(k for k in keys if len(k) < 5) or "\0"
    likely = lambda t: reduce(or_, [*[F.contains(t, F.lit(k)) for k in keys if len(k) > 4], t.rlike(f"(?<![\\p{{L}}\\p{{N}}])(?:{short})(?![\\p{{L}}\\p{{N}}])")])
    own = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), let(low, lambda t: F.when(likely(t), words(t))).alias("w"))
    own = stored(own, "words")
    t = F.broadcast(template_table(docs.sparkSession, templates))  # fixed, a few thousand rows
    grams = own.filter("size(w) > 1").select("row", "w", F.posexplode("w").alias("pos", "x"))
    grams = grams.select("row", "pos", F.concat_ws(" ", "x", F.get("w", F.col("pos") + 1)).alias("bigram"))
    hits = grams.join(t, "bigram").groupBy("row", "template", "license", "size", "span").agg(F.sort_array(F.collect_list(F.struct("pos", "bigram"))).alias("h"), F.count_distinct("bigram").alias("c"))
    hits = stored(hits.filter(F.col("c") >= bound * F.col("size")).drop("c"), "hits")
    # a window needs so many hits before its end
    last = F.ceil(bound * F.col("size") - 1e-9).cast("int") - 1
    able = F.filter(F.transform("h", lambda x, i: F.struct(x["pos"].alias("pos"), F.slice(F.col("h"), i + 1, F.col("span")).alias("in"), F.get(F.col("h"), i + last)["pos"].alias("then"))), lambda x: x["then"] < x["pos"] + F.col("span"))
    starts = hits.select("row", "template", "license", "size", "span", F.explode(able).alias("x"))
    inside = F.transform(F.filter("x.in", lambda y: y["pos"] < F.col("x.pos") + F.col("span")), lambda y: y["bigram"])
    starts = starts.select("row", "template", "license", "size", "span", F.col("x.pos").alias("start"), F.size(F.array_distinct(inside)).alias("c"))
    text = own.join(hits.select("row").distinct(), "row", "left_semi").select("row", "w")
    cut = F.slice("w", F.col("start") + 1, F.col("span") + 1)
    n = let(cut, lambda v: F.size(F.array_distinct(F.transform(F.slice(v, F.lit(1), F.size(v) - 1), lambda x, i: F.concat_ws(" ", x, F.get(v, i + 1))))))
    scored = starts.join(text, "row").select("row", "template", "license", "size", "span", "start", F.least(F.col("start") + F.col("span") + 1, F.size("w")).alias("end"), (2.0 * F.col("c") / (n + F.col("size"))).alias("score")).filter(F.col("score") >= threshold)
    order = Window.partitionBy("row", "template").orderBy("start")
    far = F.coalesce(F.col("start") - F.lag("start").over(order) > F.col("span") / 2, F.lit(True))
    runs = scored.withColumn("far", far.cast("int")).withColumn("run", F.sum("far").over(order))
    found = runs.groupBy("row", "template", "license", "run").agg(F.min(F.struct((-F.col("score")).alias("s"), "start", "end")).alias("m"))
    found = found.groupBy("row").agg(F.collect_list(F.struct(F.col("m.s").alias("s"), (F.col("m.start") - F.col("m.end")).alias("l"), F.col("m.start").alias("start"), "template", F.col("m.end").alias("end"), "license")).alias("all"))
    kept = F.filter("all", lambda x: ~F.exists("all", lambda y: (y < x) & (y["start"] < x["end"]) & (x["start"] < y["end"])))
    found = found.select("row", F.array_sort(kept).alias("m"))
    listed = F.array_sort(F.transform("m", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["license"].alias("license"), (-x["s"]).alias("score"))))
    out = own.select("row", "doc_id").join(found, "row", "left")
    return out.select("doc_id", F.coalesce(F.size("m"), F.lit(0)).cast("long").alias("n_matches"), F.get("m", F.lit(0))["license"].alias("license"), F.round(-F.get("m", F.lit(0))["s"], 6).alias("score"), F.coalesce(listed, F.array().cast("array<struct<start:int,end:int,license:string,score:double>>")).alias("matches"))


def license_sql(templates=TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The same scan for DuckDB over documents (no null or repeated ids), without pruning."""
    quoted = ", ".join(f"({i}, '{name}', '{text.replace(chr(39), chr(39) * 2)}')" for i, (name, text) in enumerate(templates))
    grams = lambda w: f"list_transform(range(1, len({w})), lambda i: {w}[i] || ' ' || {w}[i + 1])"
    split = lambda text: f"list_filter(regexp_split_to_array(lower({text}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
    return f"""
    WITH t AS (SELECT id, license, len(w) - 1 AS sp, list_distinct({grams('w')}) AS b FROM (SELECT id, license, {split('text')} AS w FROM (VALUES {quoted}) v(id, license, text))),
    g AS (SELECT doc_id, {grams('w')} AS g FROM (SELECT doc_id, {split("coalesce(text, '')")} AS w FROM documents)),
    p AS (SELECT doc_id, unnest(g) AS x, generate_subscripts(g, 1) AS p FROM g),
    tb AS (SELECT id, license, len(b) AS m, sp, unnest(b) AS x FROM t),
    s AS (SELECT DISTINCT doc_id, id, license, m, sp, p FROM p JOIN tb USING (x)),
    c AS (SELECT s.*, g.g[p:p + sp - 1] AS v, len(g.g) AS n FROM s JOIN g USING (doc_id)),
    sc AS (SELECT doc_id, c.id, c.license, m, c.sp, p, least(p + c.sp, n + 1) AS z, 2.0 * len(list_intersect(v, t.b)) / (len(list_distinct(v)) + m) AS score FROM c JOIN t ON t.id = c.id),
    ok AS (SELECT *, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id, id ORDER BY p) <= sp / 2.0 THEN 0 ELSE 1 END AS far FROM sc WHERE score >= {threshold}),
    ru AS (SELECT *, sum(far) OVER (PARTITION BY doc_id, id ORDER BY p) AS run FROM ok),
    ma AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, id, run ORDER BY score DESC, p) AS k FROM ru) WHERE k = 1),
    ke AS (SELECT * FROM ma x WHERE NOT EXISTS (SELECT 1 FROM ma y WHERE y.doc_id = x.doc_id AND y.p <= x.z AND x.p <= y.z AND (-y.score, y.p - y.z, y.p, y.id) < (-x.score, x.p - x.z, x.p, x.id))),
    b AS (SELECT doc_id, count(*) AS n_matches, first(license ORDER BY score DESC, p - z, p, id) AS license, max(score) AS score FROM ke GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n_matches, 0)::BIGINT AS n_matches, license, round(score, 6)::DOUBLE AS score FROM documents d LEFT JOIN b USING (doc_id)"""
