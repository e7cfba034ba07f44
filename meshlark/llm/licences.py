"""Licence scan: TF-IDF cosine of lines, stretches of lines and licence files to notices, then inheritance from the nearest directory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlark.session import cut

#: Licence texts, titles and notices as (SPDX name, words that a text must have to be called so, text).
#: BSD, GPL and LGPL are what texts are called that do not say which one.
NOTICES = [
    ("MIT", "mit license", "MIT License"),
    ("MIT", "mit license", "Released under the MIT License."),
    ("MIT", "permission granted charge", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", "permission granted charge", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,
        modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is
        furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all
        copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,
        INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL
        THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
        OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", "isc license", "ISC License"),
    ("ISC", "permission granted fee", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND
        THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO
        EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
        LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION
        WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("BSD", "redistribution conditions", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-2-Clause", "bsd 2 clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "bsd 3 clause", "Released under the BSD 3-Clause License."),
    *((f"BSD-{n}-Clause", must, f"""Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
        following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
        following disclaimer in the documentation and/or other materials provided with the distribution. {third} THIS SOFTWARE IS PROVIDED BY
        THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
        WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR
        CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED
        TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY
        THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE
        USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""") for n, must, third in (
            (2, "redistributions disclaimer", ""),
            (3, "redistributions endorse", """3. Neither the name of the copyright holder nor the names of its contributors may be used to
        endorse or promote products derived from this software without specific prior written permission."""))),
    ("Apache-2.0", "apache license 2", "Apache License Version 2.0, January 2004"),
    ("Apache-2.0", "apache license 2", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "apache license 2", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
        with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or
        agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY
        KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    *((f"{name}-{version}", f"{words} general public license {version.replace('.', ' ').removesuffix(' 0')}", text) for name, words, full, dated in (
        ("GPL", "gnu", "GNU General Public License", (("2.0", "2", "June 1991"), ("3.0", "3", "29 June 2007"))),
        ("LGPL", "lesser", "GNU Lesser General Public License", (("2.1", "2.1", "February 1999"), ("3.0", "3", "29 June 2007"))),
        ("AGPL", "affero", "GNU Affero General Public License", (("3.0", "3", "19 November 2007"),)))
      for version, said, date in dated for text in (
        f"{full} Version {said}, {date}",
        f"This work is licensed under the {full}, version {said}.",
        f"""This program is free software: you can redistribute it and/or modify it under the terms of the {full} as published by the Free
        Software Foundation, either version {said} of the License, or (at your option) any later version.""")),
    ("GPL", "gnu general public license", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("LGPL", "lesser general public license", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("MPL-2.0", "mozilla public license 2", "Mozilla Public License Version 2.0"),
    ("MPL-2.0", "mozilla public license 2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "creative commons attribution 4", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    *((f"CC-{kind}-4.0", f"cc {kind.replace('-', ' ').lower()} 4", f"Licensed under CC {kind} 4.0.") for kind in (
        "BY", "BY-NC", "BY-NC-ND", "BY-NC-SA", "BY-ND", "BY-SA")),
]
GENERAL = ["BSD", "GPL", "LGPL"]
#: The SPDX line of each name, made by rule.
NOTICES += [(name, "spdx " + name.replace("-", " ").replace(".", " ").lower(), f"SPDX-License-Identifier: {name}")
            for name in dict.fromkeys(n[0] for n in NOTICES) if name not in GENERAL]
LEAST = 0.6
SPLIT = r"[^\p{L}\p{N}]+"
LICENCE_FILE = r"(?i)(^|/)(licen[cs]e|copying|notice|unlicense)(\.[^/]*)?$"
#: Marks the place of lines that are not like a licence.
GAP = "\x1e"


def terms(text: Column) -> Column:
    """The words of a text, as often as they are said."""
    return F.filter(F.split(F.lower(text), SPLIT), lambda w: w != "")


def notice_terms(spark: SparkSession) -> DataFrame:
    """(notice, licence, term, tf, must, n_must), from the fixed notices: ``must`` is 1 where the licence's name needs the term."""
    rows = F.explode(F.array(*(F.struct(
        F.lit(k).alias("notice"), F.lit(name).alias("licence"), F.lit(must).alias("must"), F.lit(text).alias("text"))
        for k, (name, must, text) in enumerate(NOTICES)))).alias("n")
    said = spark.range(1).select(rows).select("n.notice", "n.licence", F.split("n.must", " ").alias("must"), F.explode(terms(F.col("n.text"))).alias("term"))
    return said.groupBy("notice", "licence", "must", "term").agg(F.count(F.lit(1)).alias("tf")).select(
        "notice", "licence", "term", "tf", F.array_contains("must", F.col("term")).cast("int").alias("must"), F.size("must").alias("n_must"))


def units(files: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(path, th, unit, terms) of what is compared; ``th`` is the text's hash.

    Each line that has a word; all of a licence file; each stretch of adjacent lines of which at least half of the
    words are in ``vocabulary`` (lines without words do not end it); each two neighbouring worded lines of a stretch.
    """
    lined = files.select("path", F.xxhash64("text").alias("th"), "text", F.split("text", "\n").alias("lines"))
    alike = lambda line: 2 * F.size(F.filter(terms(line), lambda w: w.isin(vocabulary))) >= F.size(terms(line))
    marked = F.array_join(F.transform("lines", lambda line: F.when(alike(line), line).otherwise(GAP)), "\n")
    named = lined.select("path", "th", "text", "lines", F.filter(F.split(marked, GAP), lambda s: F.size(terms(s)) > 0).alias("stretches"))
    worded = lambda s: F.filter(F.split(s, "\n"), lambda line: F.size(terms(line)) > 0)
    pairs = F.flatten(F.transform(F.transform("stretches", worded), lambda lines: F.transform(
        F.slice(lines, 1, F.size(lines) - 1), lambda line, k: F.concat(line, F.lit("\n"), F.get(lines, k + 1)))))
    whole = F.when(F.col("path").rlike(LICENCE_FILE), F.array("text")).otherwise(F.array().cast("array<string>"))
    parts = named.select("path", "th", F.posexplode(F.concat("lines", "stretches", pairs, whole)).alias("unit", "part"))
    return parts.select("path", "th", "unit", terms(F.col("part")).alias("terms")).filter(F.size("terms") > 0)


def own_licences(files: DataFrame, least: float = LEAST) -> DataFrame:
    """(path, th, licence, score): the best notice of each text, if its cosine is ``least`` or more.

    Weights are term counts times the inverse frequency of the term among all worded lines of all texts. What says
    which licence of its kind it is goes before what does not, then the better score, then the name.

    A unit without all the words that some notice's licence needs cannot be called so and is dropped where it is read;
    only the others' words are joined with their frequencies.
    """
    spark = files.sparkSession
    lines = files.select(F.explode(F.split("text", "\n")).alias("line")).select(F.array_distinct(terms(F.col("line"))).alias("terms")).filter(F.size("terms") > 0)
    counted = cut(lines.select(F.explode(F.array_append("terms", F.lit(""))).alias("term")).groupBy("term").agg(
        F.count(F.lit(1)).alias("df")), "line-frequencies")  # the empty word counts the lines
    total = counted.filter("term = ''").select((F.col("df") + 1).cast("double").alias("n"))
    idf = F.log(F.col("n") / (F.coalesce("df", F.lit(0)) + 1))
    notices = cut(notice_terms(spark).coalesce(1), "notices")
    vocabulary = [r.term for r in notices.select("term").distinct().sort("term").collect()]  # as many as NOTICES has
    weights = notices.join(counted, "term", "left").withColumn("n", total.scalar()).select(
        "notice", "licence", "term", (F.col("tf") * idf).alias("w"), "must", "n_must")
    needs = [must.split() for must in dict.fromkeys(must for _, must, _ in NOTICES)]
    telling = sorted({w for must in needs for w in must})
    met = F.array_distinct(F.filter("terms", lambda w: w.isin(telling)))
    fits = lambda words: (F.size(words) >= min(map(len, needs))) & F.exists(
        F.lit(needs), lambda must: F.size(F.array_except(must, words)) == 0)
    near = units(files, vocabulary).filter(F.exists(F.array(met), fits))  # as a lambda's variable the words are found once
    said = near.groupBy("path", "th", "unit").agg(F.first("terms").alias("terms")).select("path", "th", "unit", F.explode("terms").alias("term"))
    tf = said.groupBy("path", "th", "unit", "term").agg(F.count(F.lit(1)).alias("tf")).join(counted, "term").withColumn("n", total.scalar())
    tf = cut(tf.select("path", "th", "unit", "term", (F.col("tf") * idf).alias("u")), "unit-weights")
    same_unit = [F.col(c).eqNullSafe(F.col(f"s_{c}")) for c in ("path", "th", "unit")]
    sizes = tf.groupBy(*(F.col(c).alias(f"s_{c}") for c in ("path", "th", "unit"))).agg(F.sum(F.col("u") * F.col("u")).alias("size"))
    norms = weights.groupBy("notice").agg(F.sum(F.col("w") * F.col("w")).alias("norm"))
    dots = tf.join(weights, "term").groupBy("path", "th", "unit", "notice", "licence", "n_must").agg(
        F.sum(F.col("u") * F.col("w")).alias("dot"), F.sum("must").alias("n_met")).filter("n_met = n_must AND dot > 0")
    score = F.round(F.col("dot") / F.sqrt(F.col("size") * F.col("norm")), 6)
    scored = dots.join(norms, "notice").join(sizes, same_unit).withColumn("score", score).filter(F.col("score") >= least)
    return best_of(scored, "path", "th")


def best_of(scored: DataFrame, *keys: str | Column) -> DataFrame:
    """(``keys``..., licence, score): the best of each group."""
    rank = F.struct(F.col("licence").isin(GENERAL).alias("general"), (-F.col("score")).alias("s"), "licence")
    best = scored.groupBy(*keys).agg(F.min(rank).alias("b"))
    return best.select(*best.columns[:-1], "b.licence", (-F.col("b.s")).alias("score"))


def directory(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.when(path.isNotNull(), ""))


def scan(files: DataFrame, least: float = LEAST, keep: tuple[str, ...] = ()) -> DataFrame:
    """(``keep``..., path, own, score, licence, from_dir) of every row of (path, text).

    ``own`` is what the text itself says, ``licence`` that or else what the licence file of the nearest directory
    above says (``from_dir``). Directories, not files, climb their paths: each distinct one meets the licensed ones
    among its ancestors by a join. Of two licence files in one directory the one that says which licence of its kind
    it is wins, then the better score, then the name. Texts of any length are looked through line by line and in
    stretches of lines like a licence's; an empty table gives none.

    Null or empty texts say nothing but inherit; a null path neither inherits nor licenses; repeated rows get the
    same answer each; columns beyond ``keep`` are dropped. Without a licensed directory nothing is inherited.
    """
    own = cut(own_licences(files.select("path", "text"), least), "own-licences")
    licensed = best_of(own.filter(F.col("path").rlike(LICENCE_FILE)), directory(F.col("path")).alias("from_dir")).select(
        "from_dir", F.col("licence").alias("inherited"))
    rows = files.select(*keep, "path", F.xxhash64("text").alias("th"), directory(F.col("path")).alias("dir"))
    parts = F.split("dir", "/")
    above = F.array_prepend(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/")), "")
    climbed = rows.select("dir").filter("dir IS NOT NULL").distinct().select("dir", F.explode(F.array_distinct(above)).alias("from_dir"))
    nearest = climbed.join(licensed, "from_dir").groupBy("dir").agg(
        F.max(F.struct(F.length("from_dir").alias("depth"), "from_dir", "inherited")).alias("b")).select("dir", "b.from_dir", "b.inherited")
    mine = own.select(F.col("path").alias("_path"), F.col("th").alias("_th"), F.col("licence").alias("own"), "score")
    found = rows.join(mine, F.col("path").eqNullSafe(F.col("_path")) & (F.col("th") == F.col("_th")), "left").join(nearest, "dir", "left")
    inherits = F.col("own").isNull()
    return found.select(*keep, "path", "own", "score", F.coalesce("own", "inherited").alias("licence"), F.when(inherits, F.col("from_dir")).alias("from_dir"))
