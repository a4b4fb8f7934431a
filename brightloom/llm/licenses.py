"""License scans: MinHash bands over overlapping windows, then exact containment.

Texts and templates become words (letters and digits, lower case) and shingles
of five words. A template of T shingles belongs to the class L, the least power
of two of at least T; windows of that class have 2 L shingles and begin every L,
so each run of T shingles lies whole in some window. Window and template share
at least a fifth of their union where the template is contained to 80 percent,
and each of the 64 bands of one row meets with that probability: a match is
missed with probability below 1e-6. Windows without a single template shingle
can meet in no band and aren't hashed. Retrieved pairs are verified exactly.

Each pair of a window and a template that bands retrieve is verified once.

All steps are DataFrame functions. Templates are an argument, so their table is
as large as the caller makes it and no larger with the data; the shingles of
each size class are a set in the scan, the tables of templates and bands are
broadcast up to ``BROADCAST_SHINGLES`` shingles and joined by a shuffle beyond.
The default table has full texts and notices of common licenses; what it lacks
(the long texts of the GNU, Apache, Mozilla and Creative Commons licenses, which
documents name by the notices) can be passed in the same way.

Defined results: a null, empty or short text has no match. Rows repeat as they
come, each matched by itself; null ids stay. Other columns are left behind. An
empty table gives an empty result.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightloom.llm.common import require

SHINGLE = 5
BANDS = 64
PERCENT = 80
BROADCAST_SHINGLES = 1_000_000

# Texts of public licenses, and notices by which they are applied or recognised.
_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, '
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS "
    "BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
    "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
    "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_GNU_END = (
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
    "FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} for more details."
)
_GNU = "{program} is free software{colon} you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation{comma} either version {1} of the License, or (at your option) any later version. " + _GNU_END


def _gnu(name: str, version: str, program: str = "This program") -> str:
    old = version in ("2", "2.1")
    return _GNU.format(name, version, program=program, colon=";" if old else ":", comma=";" if old else ",")


TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either '
        "express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution."
    ),
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the "
        "hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies."
    ),
    "MIT": "Released under the MIT License",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "MIT-named": "Licensed under the MIT License",
    "MIT-subject": "This project is licensed under the terms of the MIT license",
    "MIT-disclaimer": _AS_IS
    + " IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
    "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "BSD-3-clause": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
        "without specific prior written permission."
    ),
    "BSD-disclaimer": _BSD_END,
    "BSD-named": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file",
    "ISC-disclaimer": (
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
        "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
        "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
        "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from "
        "the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and "
        "redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you "
        "wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not "
        "required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not "
        "be removed or altered from any source distribution."
    ),
    "BSL-1.0": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by "
        'this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the '
        "Software, and to permit third-parties to whom the Software is furnished to do so"
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this "
        "software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ),
    "CC0-1.0": (
        "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain "
        "worldwide. This software is distributed without any warranty."
    ),
    "GPL-2.0-header": _gnu("General Public License", "2"),
    "LGPL-2.1-header": _gnu("Lesser General Public License", "2.1", "This library").replace("This program", "This library"),
    "LGPL-3.0-header": _gnu("Lesser General Public License", "3"),
    "AGPL-3.0-header": _gnu("Affero General Public License", "3"),
    "GPL-2.0-only-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0",
    "EPL-1.0": "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution",
    "CC-BY-NC-SA-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License",
    "CC-BY-NC-4.0-notice": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "CC-BY-SA-3.0": "This work is licensed under the Creative Commons Attribution-ShareAlike 3.0 Unported License",
}


def template_shingles(templates: dict[str, str]) -> dict[str, list[str]]:
    """Distinct shingles of each template, as words joined by spaces, in order."""
    out = {}
    for name, text in templates.items():
        w = re.findall(r"[^\W_]+", text.lower())
        if len(w) < SHINGLE:
            raise ValueError(f"template {name} has fewer than {SHINGLE} words")
        out[name] = list(dict.fromkeys(" ".join(w[i : i + SHINGLE]) for i in range(len(w) - SHINGLE + 1)))
    return out


def size_class(shingles: int) -> int:
    return 1 << (shingles - 1).bit_length()


def _minima(shingles: Column) -> Column:
    """One minimum for each band: the least hash of any shingle under the band's seed."""
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda j: F.array_min(F.transform(shingles, lambda x: F.xxhash64(x, j))))


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, percent: int = PERCENT) -> DataFrame:
    """One row per document and license: doc_id, license, n_matched, n_template, first_word, n_windows.

    n_matched: the template's distinct shingles in the best window, the first of
    equals; first_word: where that window begins; n_windows: windows that hold
    ``percent`` of the template.
    """
    require(docs, "doc_id", "text")
    spark = docs.sparkSession
    table = [(name, size_class(len(s)), len(s), s) for name, s in template_shingles(templates).items()]
    raw = spark.createDataFrame(table, "license string, cls int, n_template int, grams array<string>")
    known = raw.select("license", "cls", "n_template", F.transform("grams", lambda g: F.xxhash64(g)).alias("grams"))
    # The hashes of template shingles by class, a fixed table, as sets for the scan.
    of_class: dict[int, set[int]] = {}
    for r in known.select("cls", "grams").collect():
        of_class.setdefault(r["cls"], set()).update(r["grams"])
    hashes = sorted(set().union(*of_class.values()))
    few = F.broadcast if sum(len(s) for _, _, _, s in table) <= BROADCAST_SHINGLES else lambda df: df

    w = F.col("w")
    gram = lambda i: F.xxhash64(F.concat_ws(" ", *[F.get(w, i + k) for k in range(SHINGLE)]))
    n = F.size(w)
    words = docs.select("doc_id", F.monotonically_increasing_id().alias("rid"), F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)).alias("w"))
    grams = words.select("doc_id", "rid", F.when(n >= SHINGLE, F.transform(F.sequence(F.lit(0), n - SHINGLE), gram)).alias("g"))
    hits = grams.select("doc_id", "rid", "g", F.filter(F.transform("g", lambda x, i: F.struct(i.alias("i"), x.alias("h"))), lambda s: s["h"].isin(hashes)).alias("hits"))

    def windows(s: Column) -> Column:
        at = lambda c, k: F.struct(F.lit(c).alias("cls"), (F.floor(s["i"] / c) - k).cast("int").alias("at"))
        none = F.slice(F.array(at(1, 0)), 1, 0)
        return F.concat(*[F.when(s["h"].isin(sorted(known_by)), F.array(at(c, 1), at(c, 0))).otherwise(none) for c, known_by in sorted(of_class.items())])

    found = F.filter(F.array_distinct(F.flatten(F.transform("hits", windows))), lambda x: x["at"] >= 0)
    cut = F.transform(found, lambda x: F.struct(x["cls"].alias("cls"), x["at"].alias("at"), F.array_distinct(F.slice("g", x["at"] * x["cls"] + 1, 2 * x["cls"])).alias("set")))
    each = hits.where(F.size("hits") > 0).select("doc_id", "rid", F.explode(cut).alias("x")).select("doc_id", "rid", "x.*")

    known = known.withColumn("t_mins", _minima(F.col("grams")))
    bands = known.select("license", F.col("cls").alias("t_cls"), F.posexplode("t_mins").alias("t_band", "t_min"))
    mins = each.withColumn("mins", _minima(F.col("set")))
    banded = mins.select("doc_id", "rid", "cls", "at", "set", "mins", F.posexplode("mins").alias("band", "least"))
    on = (F.col("cls") == F.col("t_cls")) & (F.col("band") == F.col("t_band")) & (F.col("least") == F.col("t_min"))
    met = banded.join(few(bands), on).select("doc_id", "rid", "cls", "at", "set", "mins", "band", F.col("license").alias("name"))
    verified = met.join(few(known.drop("cls")), F.col("name") == F.col("license"))
    # Of the bands that retrieve a pair, the first verifies it.
    verified = verified.where(F.array_position(F.zip_with("mins", "t_mins", lambda a, b: a == b), True) == F.col("band") + 1)
    verified = verified.withColumn("n", F.size(F.array_intersect("grams", "set"))).where(F.col("n") * 100 >= F.col("n_template") * percent)
    once = verified.groupBy("rid", "doc_id", "license", "n_template", "cls", "at").agg(F.max("n").alias("n"))
    best = F.max(F.struct(F.col("n"), (-F.col("at")).alias("back"))).alias("best")
    return once.groupBy("rid", "doc_id", "license", "n_template", "cls").agg(best, F.count(F.lit(1)).alias("n_windows")).select(
        "doc_id", "license", F.col("best.n").cast("long").alias("n_matched"), F.col("n_template").cast("long").alias("n_template"),
        (-F.col("best.back") * F.col("cls")).cast("long").alias("first_word"), "n_windows",
    )
