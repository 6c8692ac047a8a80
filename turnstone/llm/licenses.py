"""License scans with DataFrame functions alone.

A text's words are the runs of letters and digits, in lower case; its shingles are hashes of three words. A window is two
neighbouring blocks of 8 shingles, and windows overlap by a block, so of a notice longer than a window some window holds
12 or more shingles that follow one another. The MinHash of a window: for each band
the least shingle hash under that band's exclusive-or mask, found from the minima of its two blocks. A band is one
value; a template's windows at every place go into the bands' value sets.

A template of one window or less (down to one shingle, "All rights reserved.") would be alike to a text's window by a small
share only, so it is looked up without bands: of its n distinct shingles a text that holds the asked share lacks at most
n - ceil(share * n), so any one more of them has one that stands in the text. Each place of such a shingle
retrieves the template; none is missed.

Retrieved templates are confirmed by exact containment: the share of the template's shingles that stand in
the stretch of the template's length to both sides of the window or shingle.

A hit takes along the stretch that the longest template could cover, not the text. Null texts and texts of fewer than three words hold
nothing. Repeated rows give repeated results, an empty table none; of places that fit alike the first counts. Very long texts are
searched whole. The key may be null. Further columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnstone.llm.common import only

BLOCK, SHINGLE, BANDS = 8, 3, 16

#: Public notices by which texts are put under a license.
TEMPLATES = {
    "MIT-line": "Released under the MIT License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "LGPL-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "MIT-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "BSD-warranty": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution.",
    "BSL-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so",
    "all-rights-reserved-line": "All rights reserved.",
    "all-rights-reserved": "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher.",
}


def word_array(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingle_array(words: Column) -> Column:
    """Hashes of all three-word runs; empty for fewer words."""
    last = F.size(words) - SHINGLE
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(SHINGLE)]))).otherwise(F.array().cast("array<bigint>"))


def masks() -> list[int]:
    """A mask for each band: odd multiples of the golden ratio's 64-bit fraction, as signed numbers."""
    return [(x - (1 << 64) if x >> 63 else x) for x in ((0x9E3779B97F4A7C15 * (2 * b + 1)) % (1 << 64) for b in range(BANDS))]


def least(shingles: Column, mask: int) -> Column:
    return F.array_min(F.transform(shingles, lambda x: x.bitwiseXOR(F.lit(mask).cast("long"))))


def _stretch(shingles: Column, start: Column, length: Column | int) -> Column:
    return F.slice(shingles, start + 1, length)


def scan(docs: DataFrame, containment: float = 0.8, templates: dict[str, str] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, license, containment, first_word): each template found in each document, where it fits best."""
    spark = docs.sparkSession
    templates = TEMPLATES if templates is None else templates
    known = spark.createDataFrame(sorted(templates.items()), "license string, notice string")
    known = known.select("license", F.explode(F.array(word_array(F.col("notice")))).alias("words")).select("license", shingle_array(F.col("words")).alias("own")).filter("size(own) > 0")
    per_window = 2 * BLOCK
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("own") - per_window))
    short = F.size("own") <= per_window
    windows = known.filter(~short).select("license", F.explode(F.transform(starts, lambda i: _stretch(F.col("own"), i, per_window))).alias("part"))
    bands = windows.select("license", F.explode(F.array(*[F.struct(F.lit(b).alias("band"), least(F.col("part"), m).alias("value")) for b, m in enumerate(masks())])).alias("x")).select("license", "x.band", "x.value")
    distinct = F.array_distinct("own")
    may_lack = (F.size(distinct) - F.ceil(F.lit(containment) * F.size(distinct) - 1e-9)).cast("int")
    certain = known.filter(short).select("license", F.lit(BANDS).alias("band"), F.explode(F.slice(distinct, 1, F.least(may_lack + 1, F.size(distinct)))).alias("value"))
    bands = bands.union(certain).distinct()
    values = [[] for _ in range(BANDS + 1)]  # the last: shingles of the short templates
    for r in bands.collect():  # as many as the templates have windows, times the bands
        values[r["band"]].append(r["value"])

    # Each explode of one element is a barrier: the arrays are made once for a text, not once for each use in a lambda.
    rows = only(docs, key, text).select(F.col(key).alias("key"), F.explode(F.array(word_array(F.col(text)))).alias("words"))
    rows = rows.select("key", F.explode(F.array(shingle_array(F.col("words")))).alias("shingles")).withColumn("row", F.monotonically_increasing_id())
    rows = rows.filter("size(shingles) > 0")
    at = F.sequence(F.lit(0), F.size("shingles") - 1, F.lit(BLOCK))
    minima = F.transform(at, lambda i: F.array(*[least(_stretch(F.col("shingles"), i, BLOCK), m) for m in masks()]))
    blocked = rows.select("key", "row", "shingles", F.explode(F.array(minima)).alias("blocks"))

    def meets(i: Column) -> Column:
        out = F.lit(False)
        for b, known_values in enumerate(values[:BANDS]):
            out = out | F.least(F.get(F.get("blocks", i), F.lit(b)), F.get(F.get("blocks", i + 1), F.lit(b))).isin(known_values)
        return out

    longest = max((r["n"] for r in known.select(F.size("own").alias("n")).collect()), default=0)
    span = F.col("shingles")

    def hit(at: Column, long: int, found: Column) -> Column:
        begin = F.greatest(F.lit(0), at - longest)
        return F.struct(at.alias("at"), F.lit(long).alias("long"), begin.alias("begin"), _stretch(span, begin, at - begin + long + longest).alias("near"), found.alias("found"))

    def bands_of(i: Column) -> Column:
        part = lambda b: F.least(F.get(F.get("blocks", i), F.lit(b)), F.get(F.get("blocks", i + 1), F.lit(b)))
        return F.array_compact(F.array(*[F.when(part(b).isin(v), F.struct(F.lit(b).alias("band"), part(b).alias("value"))) for b, v in enumerate(values[:BANDS]) if v]))

    met = F.transform(F.filter(F.sequence(F.lit(0), F.size("blocks") - 1), meets), lambda i: hit(i * BLOCK, per_window, bands_of(i)))
    single = F.filter(F.transform("shingles", lambda x, i: F.struct(i.alias("at"), x.alias("value"))), lambda x: x["value"].isin(values[BANDS]))
    single = F.transform(single, lambda x: hit(x["at"], 1, F.array(F.struct(F.lit(BANDS).alias("band"), x["value"].alias("value")))))
    hits = blocked.select("key", "row", F.explode(F.concat(met, single) if any(values[:BANDS]) else single).alias("hit")).select("key", "row", "hit.*")
    banded = hits.select("key", "row", "at", "long", "begin", "near", F.explode("found").alias("x"))
    retrieved = banded.join(F.broadcast(bands), (F.col("x.band") == F.col("band")) & (F.col("x.value") == F.col("value"))).select("key", "row", "at", "long", "license", "begin", "near")
    length = F.size("own")
    begin = F.greatest(F.lit(0), F.col("at") - length)
    region = _stretch(F.col("near"), begin - F.col("begin"), F.col("at") - begin + F.col("long") + length)
    share = F.size(F.array_intersect(F.array_distinct("own"), region)) / F.size(F.array_distinct("own"))
    place = F.array_position(region, F.element_at("own", 1))
    judged = retrieved.join(F.broadcast(known), "license").select("key", "row", "license", share.alias("containment"), F.when(place > 0, begin + place.cast("int") - 1).otherwise(F.col("at")).alias("first_word"))
    best = judged.filter(F.col("containment") >= containment).groupBy("key", "row", "license").agg(F.max(F.struct("containment", (-F.col("first_word")).alias("p"))).alias("b"))
    return best.select(F.col("key").alias(key), "license", F.col("b.containment").alias("containment"), (-F.col("b.p")).cast("int").alias("first_word"))
