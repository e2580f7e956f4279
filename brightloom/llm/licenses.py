"""License scans by diagonal voting.

Every rolling k-gram of words of every text is hashed and joined, in Spark, with
the k-grams of the license templates. A match at word p of the text and word q
of the template votes for the diagonal p - q. Votes are counted for each
diagonal, neighbouring diagonals (an inserted or dropped word moves the rest by
one) are merged, and each merged run is verified: the words of the text from the
run's beginning to its end, with the template's unmatched margins, must be
within `MAX_DISTANCE` of the template's text by Levenshtein distance.

Templates are those of this module (notices, headers and short licenses in full;
of Apache, GPL, LGPL, AGPL, MPL and EPL the header or notice) or any others, as a
dictionary or a frame (`templates_in` reads a folder of license texts). Their k-grams
are broadcast if they are few, else the join shuffles. Votes are few against the
words of the corpus; the texts are looked at again only for documents with enough
votes.

Words are runs of letters, digits, dots inside them, and underscores, in lower
case.

Defined results: null, empty and wordless texts, and texts shorter than the
shortest template, have no spans; very long texts are scanned whole; a null doc_id
is carried through; each of several occurrences is a span of its own, and spans of
different licenses may overlap, also where they are equally close; repeated rows
(same doc_id and text) are scanned once; different texts under one doc_id are told
apart; an empty table gives no rows; further columns, whatever their names, are
ignored. A template of fewer than K words fails the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brightloom.llm.common import cut, sized

K = 3
#: Votes a run needs, as a share of the template's k-grams.
VOTES = 0.5
#: Diagonals this close are one run.
DRIFT = 2
MAX_DISTANCE = 0.15
WORDS = r"[\p{L}\p{N}_]+(?:[.\-][\p{L}\p{N}_]+)*"

TEMPLATES = {
    "MIT (notice)": "Released under the MIT License.",
    "Apache-2.0 (notice)": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0 (notice)": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0 (notice)": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 (notice)": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD (disclaimer)": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSD-3-Clause (third clause)": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "MIT (disclaimer)": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "BSL-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    "WTFPL": "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "LGPL": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "CC-BY-SA-4.0 (notice)": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0 (notice)": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "EPL-2.0 (notice)": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "MPL-2.0 (notice)": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORDS), F.lit(0))


def gram_hashes(tokens: Column) -> Column:
    """Hashes of the word k-grams at positions 0, 1, ..."""

    def of(t: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(t) - K)
        return F.when(F.size(t) >= K, F.transform(at, lambda i: F.xxhash64(*[F.get(t, i + j) for j in range(K)]))).otherwise(F.array().cast("array<bigint>"))

    # bound as a lambda's variable, the words are found once for a text, not once for a position
    return F.get(F.transform(F.array(tokens), of), F.lit(0))


def templates_in(spark: SparkSession, folder: str) -> DataFrame:
    """(license, raw) of the text files in a folder, named for their files."""
    files = spark.read.text(folder, wholetext=True)
    return files.select(F.regexp_replace(F.regexp_extract(F.col("_metadata.file_name"), r"[^/]+$", 0), r"\.[A-Za-z]+$", "").alias("license"), F.col("value").alias("raw"))


def template_table(spark: SparkSession, templates: dict[str, str] | DataFrame) -> DataFrame:
    """(license, template, n) with the template's words."""
    rows = spark.createDataFrame(list(templates.items()), "license string, raw string") if isinstance(templates, dict) else templates
    n = F.when(F.size("template") < K, F.raise_error(F.concat(F.lit(f"a template of fewer than {K} words: "), "license")).cast("int")).otherwise(F.size("template"))
    return cut(rows.select("license", words(F.col("raw")).alias("template")).withColumn("n", n))


def runs(docs: DataFrame, templates: DataFrame) -> DataFrame:
    """(doc_id, check, license, from_word, to_word, votes): merged diagonals with enough votes.

    check is a hash of the text, for documents that share an id.
    """
    grams = templates.select("license", "n", F.posexplode(gram_hashes(F.col("template"))).alias("q", "gram"))
    n_grams = templates.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    text = F.col("text")
    votes = (
        docs.where(text.isNotNull())
        .select("doc_id", F.xxhash64(text).alias("check"), F.posexplode(gram_hashes(words(text))).alias("p", "gram"))
        .join(sized(grams, n_grams), "gram")
        .groupBy("doc_id", "check", "license", "n", (F.col("p") - F.col("q")).alias("diagonal"))
        .agg(F.count_distinct("p").alias("votes"), F.min("q").alias("q_from"), F.max("q").alias("q_to"), F.min("p").alias("p_from"), F.max("p").alias("p_to"))
    )
    own = Window.partitionBy("doc_id", "check", "license").orderBy("diagonal")
    # a run ends where the diagonal jumps, or where the template begins anew
    fresh = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(own) > DRIFT, F.lit(True)) | (F.col("p_from") - F.lag("p_to").over(own) > F.col("n"))
    return (
        votes.withColumn("run", F.sum(fresh.cast("int")).over(own))
        .groupBy("doc_id", "check", "license", "n", "run")
        .agg(F.sum("votes").alias("votes"), F.min(F.col("p_from") - F.col("q_from")).alias("from_word"), F.max(F.col("p_to") + F.col("n") - F.col("q_to")).alias("to_word"))
        .where(F.col("votes") >= F.greatest(F.lit(1), F.ceil(VOTES * (F.col("n") - K + 1))))
        .drop("run")
    )


def scan(docs: DataFrame, templates: dict[str, str] | DataFrame | None = None) -> DataFrame:
    """Verified spans (doc_id, license, from_word, to_word, votes, distance) in words of the text."""
    table = template_table(docs.sparkSession, TEMPLATES if templates is None else templates)
    found = cut(runs(docs, table))
    n = found.count()
    text = F.col("text")
    hashed = docs.where(text.isNotNull()).select(F.col("doc_id").alias("__id"), F.xxhash64(text).alias("__check"), "text")
    again = hashed.join(sized(found, n), hashed["__id"].eqNullSafe(found["doc_id"]) & (hashed["__check"] == found["check"]))
    tokens = words(text)
    spans = (
        again.withColumn("tokens", tokens)
        .withColumn("from_word", F.greatest(F.col("from_word"), F.lit(0)))
        .withColumn("to_word", F.least(F.col("to_word"), F.size("tokens")))
        .withColumn("span", F.array_join(F.slice("tokens", F.col("from_word") + 1, F.greatest(F.col("to_word") - F.col("from_word"), F.lit(0))), " "))
        .select("doc_id", "license", "from_word", "to_word", "votes", "span")
        .distinct()
        .join(sized(table.select("license", F.array_join("template", " ").alias("whole")), table.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]), "license")
    )
    return (
        spans.withColumn("distance", F.levenshtein("span", "whole"))
        .where(F.col("distance") <= F.floor(MAX_DISTANCE * F.length("whole")))
        .select("doc_id", "license", "from_word", "to_word", F.col("votes").cast("int").alias("votes"), "distance")
    )
