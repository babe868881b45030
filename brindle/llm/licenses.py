"""Licences in texts, found by Dice coefficient over word bigrams.

Windows of a whole text, across line ends and inside lines, are compared with
licence templates that an inverted list of their bigrams selects; bounds of
size leave most templates and windows out.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The usual short notices and titles of public licences, their
#: permission texts, and the headers that they ask files to carry.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("MIT", "MIT License"),
    ("ISC", "ISC License"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
)
MIN_DICE = 0.8


def template_bigrams(templates: tuple[tuple[str, str], ...] = TEMPLATES) -> list[tuple[int, str, list[str]]]:
    """Number, licence and sorted distinct word bigrams of each template."""
    out = []
    for k, (name, text) in enumerate(templates):
        words = re.sub("[^a-z0-9]+", " ", text.lower()).split()
        pairs = sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})
        if pairs:
            out.append((k, name, pairs))
    return out


def scan_licenses(
    df: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: tuple[tuple[str, str], ...] = TEMPLATES,
    min_dice: float = MIN_DICE,
) -> DataFrame:
    """Every passage of every text that resembles a licence template, across line ends and inside lines.

    A text is normalised as a whole (lower case; anything but a-z and 0-9 is one
    space) and cut into word bigrams. Windows of all lengths that can reach
    ``min_dice`` are compared: of a window's w bigrams (each place counts), s
    distinct ones are among a template's n, and its coefficient is 2s / (w + n).
    Windows that overlap are one passage: the one with the largest product of
    coefficient and s stands, then the best ``dice``, the first template and the
    first place.

    A window of w bigrams can only reach the bound t for t/(2-t) * n <= w <=
    n (2-t)/t, and shares no fewer than t/(2-t) * n with its template: texts
    with fewer hits of a template are not compared with it. Only bigrams of
    templates are shuffled. Columns: the id column, ``word_no`` (from 0) and
    ``words`` of the passage, ``license``, ``template_no`` and ``dice``. Null
    and empty texts match nothing; repeated rows are scanned row by row; an
    empty table gives no rows; other columns are not read.
    """
    spark = df.sparkSession
    known, long = [], []
    for k, name, bigrams in template_bigrams(templates):
        known += [(b, k) for b in bigrams]
        long.append((k, name, len(bigrams)))
    ratio = min_dice / (2 - min_dice)
    if not long:
        known, long = [("", -1)], [(-1, "", 1)]  # nothing that a text could have
    # Words of templates are letters and digits, so they need no escapes.
    grams = F.broadcast(spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{b}', {k})" for b, k in known) + " AS t(gram, template_no)"))
    sizes = F.broadcast(spark.sql("SELECT * FROM VALUES " + ", ".join(f"({k}, '{name}', {n})" for k, name, n in long) + " AS t(template_no, license, n)"))
    plain = F.trim(F.regexp_replace(F.lower(text_col), "[^a-z0-9]+", " "))
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.explode(F.array(F.split(plain, " "))).alias("w"))
    follow = F.slice("w", F.lit(2), F.size("w") - 1)
    pairs = F.zip_with(F.slice("w", F.lit(1), F.size("w") - 1), follow, lambda a, b: F.concat(a, F.lit(" "), b))
    hits = rows.where(F.size("w") > 1).select("row", "id", F.posexplode(pairs).alias("pos", "gram")).join(grams, "gram")
    found = hits.groupBy("row", "id", "template_no").agg(F.array_sort(F.collect_list(F.struct("pos", "gram"))).alias("hits")).join(sizes, "template_no")
    # A window has no fewer bigrams than it shares, so fewer than this are never enough.
    found = found.where(F.size("hits") >= F.col("n") * (ratio * (1 - 1e-9)))

    # ``prev``: where the template's bigram was before, so that a window counts it once.
    same = Window.partitionBy("row", "template_no", F.col("h.gram")).orderBy("h.pos")
    found = found.select("row", "id", "template_no", "license", "n", F.explode("hits").alias("h")).withColumn("prev", F.lag("h.pos", 1, -1).over(same))
    hit = F.struct(F.col("h.pos").alias("pos"), "prev")
    found = found.groupBy("row", "id", "template_no", "license", "n").agg(F.array_sort(F.collect_list(hit)).alias("hits"))
    most = F.ceil(F.col("n") / ratio).cast("int")

    def window(i):
        start = F.element_at("hits", i)["pos"]
        inside = F.filter(F.slice("hits", i, most), lambda h: h["pos"] < start + most)
        none = F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("s"), F.lit(0).alias("w"), F.lit(0.0).alias("dice"), F.lit(0).alias("seen"))

        def step(best, h):
            seen = best["seen"] + (h["prev"] < start).cast("int")
            w = h["pos"] - start + 1
            dice = 2.0 * seen / (w + F.col("n"))
            better = (dice >= min_dice) & (dice * seen > best["score"])
            pick = lambda new, name: F.when(better, new).otherwise(best[name]).alias(name)
            return F.struct(pick(dice * seen, "score"), pick(seen, "s"), pick(w, "w"), pick(dice, "dice"), seen.alias("seen"))

        return F.struct(F.aggregate(inside, none, step).alias("best"), start.alias("start"))

    windows = found.select("row", "id", "template_no", "license", F.explode(F.transform(F.sequence(F.lit(1), F.size("hits")), window)).alias("x"))
    scored = windows.select("row", "id", "x.best.*", "x.start", "template_no", "license").where("s > 0")
    one = F.struct((-F.col("score")).alias("score"), (-F.col("dice")).alias("dice"), "template_no", "start", "w", "license")
    apart = lambda kept, x: ~F.exists(kept, lambda y: (x["start"] <= y["start"] + y["w"]) & (y["start"] <= x["start"] + x["w"]))
    ranked = scored.groupBy("row", "id").agg(F.array_sort(F.collect_list(one)).alias("ranked"))
    none = F.slice("ranked", 1, 0)
    best = ranked.select("id", F.explode(F.aggregate("ranked", none, lambda kept, x: F.when(apart(kept, x), F.concat(kept, F.array(x))).otherwise(kept))).alias("x"))
    return best.select(
        F.col("id").alias(id_col), F.col("x.start").alias("word_no"), (F.col("x.w") + 1).alias("words"), F.col("x.license").alias("license"), F.col("x.template_no").alias("template_no"), (-F.col("x.dice")).alias("dice")
    )
