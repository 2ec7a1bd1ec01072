"""License notices found by MinHash bands over text windows, verified by exact shingle containment.

Only DataFrame and SQL functions are used here.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaline.llm.common import Written, id_back, id_key, spread

_AS_IS = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO "
    "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
    "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, "
    "TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
#: License texts, standard headers, notices and passages, by name.
TEMPLATES = {
    "AGPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) "
        "any later version."
    ),
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with "
        "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
        "applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
        "governing permissions and limitations under the License."
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted "
        "provided that the following conditions are met"
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution."
    ),
    "BSD-3-Clause-endorsement": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
        "derived from this software without specific prior written permission."
    ),
    "BSL-1.0": (
        "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at "
        "https://www.boost.org/LICENSE_1_0.txt)"
    ),
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-2.0-or-later-header": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later "
        "version."
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-or-later-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
        "version."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "LGPL-2.1-or-later-header": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) "
        "any later version."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files, to deal in the Software without restriction"
    ),
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice "
        "and this permission notice shall be included in all copies or substantial portions of the Software. " + _AS_IS
    ),
    "MPL-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
        "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
        "commercial or non-commercial, and by any means."
    ),
}
WORD = r"[\p{L}\p{N}]+"
SHINGLE = 5
WINDOW, STEP = 64, 32
BANDS = 16
CONTAINMENT = 0.8
#: Up to so many distinct shingles of all templates are part of the plan; more are joined.
PLAN_SHINGLES = 10_000


def template_words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def _template_shingles(spark: SparkSession, templates: Mapping[str, str]) -> list[tuple[str, int, int, int]]:
    """(license, words, position, hash) of each template's shingles; hashed by Spark as the documents' are."""
    rows = []
    for name, text in sorted(templates.items()):
        words = template_words(text)
        if len(words) < SHINGLE:
            raise ValueError(f"the template {name} has fewer than {SHINGLE} words")
        rows += [(name, len(words), i, words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)]
    table = spark.createDataFrame(rows, "license string, words int, pos int, shingle array<string>")
    hashed = table.select("license", "words", "pos", F.xxhash64(*[F.col("shingle")[i] for i in range(SHINGLE)]).alias("h"))
    return [tuple(r) for r in hashed.collect()]


def _windows(pos: Column, margin: Column | int = 0) -> Column:
    """The numbers of the windows, widened by `margin`, that a shingle at word `pos` lies within; window w starts at word w * STEP."""
    last = F.floor((pos + margin) / STEP).cast("int")
    first = F.greatest(F.lit(0), F.ceil((pos + SHINGLE - WINDOW - margin) / STEP).cast("int"))
    return F.sequence(first, last)


def _signature(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, band, value): MinHash values of the distinct shingles of each group, one band for each value."""
    least = [F.min(F.xxhash64("h", F.lit(k))).alias(f"b{k}") for k in range(BANDS)]
    bands = F.array(*[F.struct(F.lit(k).alias("band"), F.col(f"b{k}").alias("value")) for k in range(BANDS)])
    return rows.groupBy(*keys).agg(*least).select(*keys, F.explode(bands).alias("x")).select(*keys, "x.band", "x.value")


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, plan_shingles: int = PLAN_SHINGLES) -> DataFrame:
    """License templates that occur in texts: key, text_hash, license, containment, first_word, end_word.

    Words are runs of letters and digits, lower-cased; shingles have five words. Texts
    are cut into windows of 64 words that overlap by half, each widened on both sides by
    the template's length. For each template a window has a MinHash of its own, over the
    template's shingles in it, which are compared with those of the whole template: other
    notices in the window don't count. With 16 bands of one value, a window that holds
    0.8 of a template is retrieved with probability 1 - 0.2**16 or more. A match is
    verified exactly: the share of the template's distinct shingles that occur in the
    widened window, one of them in the window itself, must be 0.8 or more.

    One row for each document and template, with the greatest containment and the words
    from the first to the last window's shingle found. Null and empty texts have none.
    Rows that share an id, or have none, are matched each by its own text; rows equal in
    id and text count once. The templates are given with the call; up to `plan_shingles`
    of their shingles, checked, are part of the plan and broadcast, more are joined as tables.
    """
    spark = docs.sparkSession
    shingles = _template_shingles(spark, templates)
    known = sorted({h for _, _, _, h in shingles})
    # a row is told by its id and a hash of its text; rows equal in both have the same matches
    listed = docs.select(F.struct(id_key().alias("id"), F.xxhash64("text").alias("of")).alias("key"), F.regexp_extract_all(F.lower(F.col("text")), F.lit(WORD), F.lit(0)).alias("words"))
    starts = F.when(F.size("words") >= SHINGLE, F.sequence(F.lit(0), F.size("words") - SHINGLE))
    hits = (
        spread(listed)
        .select("key", "words", F.explode(starts).alias("pos"))
        .select("key", "pos", F.xxhash64(*[F.get("words", F.col("pos") + k) for k in range(SHINGLE)]).alias("h"))
    )
    held = len(known) <= plan_shingles
    small = spark.createDataFrame(shingles, "license string, words int, pos int, h long")
    hits = hits.filter(F.col("h").isin(known)) if held else hits.join(small.select("h").distinct(), "h", "left_semi")
    near = F.broadcast if held else lambda df: df
    hits = Written(hits.dropDuplicates(["key", "pos"]), "hits").df
    own = small.select(F.col("license").alias("l"), "words", F.col("h").alias("t")).distinct()
    sizes = own.groupBy("l").agg(F.count("*").alias("size"))
    wanted = _signature(own.withColumnRenamed("t", "h"), "l")
    wide = (
        hits.join(near(own), F.col("h") == F.col("t"))
        .select("key", "l", "pos", "h", F.explode(_windows(F.col("pos"), F.col("words"))).alias("w"))
        .withColumn("inside", F.array_contains(_windows(F.col("pos")), F.col("w")))
    )
    seen = _signature(wide, "key", "l", "w")
    candidates = seen.join(near(wanted), ["l", "band", "value"]).select("key", "l", "w").distinct()
    verified = (
        wide.join(candidates, ["key", "l", "w"])
        .groupBy("key", "l", "w")
        .agg(
            F.countDistinct("h").alias("n"), F.min("pos").alias("first_word"), F.max(F.col("pos") + SHINGLE).alias("end_word"),
            F.max("inside").alias("inside"),
        )
        .join(near(sizes), "l")
        .withColumn("containment", F.col("n") / F.col("size"))
        .filter((F.col("containment") >= CONTAINMENT) & F.col("inside"))
    )
    found = verified.groupBy("key", F.col("l").alias("license")).agg(
        F.max("containment").alias("containment"), F.min("first_word").alias("first_word"), F.max("end_word").alias("end_word")
    )
    return found.select(F.col("key.id").alias("key"), F.col("key.of").alias("text_hash"), "license", "containment", "first_word", "end_word")


def op7(docs: DataFrame) -> DataFrame:
    """One row for each document and license found: doc_id, license, containment, first_word, end_word."""
    found = scan(docs.select("doc_id", "text"))
    return found.select(id_back(F.col("key")).alias("doc_id"), "license", "containment", "first_word", "end_word")
