"""Licence scans: a trained paragraph classifier in DataFrame and SQL functions.

A paragraph ends at a blank line and at a line that ends a sentence, so that
wrapped notices are read as one and single lines of prose by themselves.
Paragraphs are classified into licence families by multinomial logistic
regression on word 1- to 4-grams that hold an anchor, a word of licences. It is
fitted here: on sentences of the notices of each family, with words left out or
wrapped in other text, and on paragraphs of the corpus and prose about licences
as the unknown class. The probabilities are calibrated by a temperature fitted on
notices that were held out of the fit as a whole, and a family below ``least`` is
unknown. A prediction counts once enough of the pairs of words of one of the
family's templates stand in the paragraph.

A paragraph without an anchor has no feature, so its class is that of the bias,
unknown (which the classifier asserts); only the others are scored. All features
of a paragraph meet their weights in one broadcast join and are summed.
"""

from __future__ import annotations

import math
import random
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drawn, durable

#: Usual notices of each family, a list of sentences each; the last one of a family is held out of the fit.
NOTICES = {
    "Apache": [
        ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.", "See the License for the specific language governing permissions and limitations under the License."],
        ["SPDX-License-Identifier: Apache-2.0", "Apache License Version 2.0, January 2004"],
        ["This project is released under the Apache 2.0 license."],
    ],
    "MIT": [
        ["MIT License", "The MIT License (MIT)", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
        ["Released under the MIT License.", "SPDX-License-Identifier: MIT"],
        ["This software is distributed under the terms of the MIT license."],
    ],
    "GPL": [
        ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "You should have received a copy of the GNU General Public License along with this program. If not, see http://www.gnu.org/licenses/", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "GNU General Public License, version 2"],
        ["This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-or-later", "SPDX-License-Identifier: GPL-2.0-only"],
        ["Licensed under the GPL version 2 or later."],
    ],
    "LGPL": [
        ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", "You should have received a copy of the GNU Lesser General Public License along with this library; if not, see http://www.gnu.org/licenses/"],
        ["SPDX-License-Identifier: LGPL-2.1-only", "GNU LESSER GENERAL PUBLIC LICENSE Version 3"],
        ["Licensed under the GNU Lesser General Public License, version 2.1."],
    ],
    "BSD": [
        ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
        ["Licensed under the BSD 3-Clause License.", "BSD 2-Clause License", "SPDX-License-Identifier: BSD-3-Clause"],
        ["Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."],
    ],
    "MPL": [
        ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/"],
        ["SPDX-License-Identifier: MPL-2.0", "Mozilla Public License Version 2.0"],
        ["Licensed under the Mozilla Public License 2.0."],
    ],
    "CC-BY": [
        ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"],
        ["This work is licensed under CC BY 4.0."],
        ["Licensed under CC BY 4.0."],
    ],
    "CC-BY-SA": [
        ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0"],
        ["This work is licensed under CC BY-SA 4.0."],
        ["Licensed under CC BY-SA 4.0."],
    ],
    "CC-BY-NC": [
        ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
        ["This work is licensed under CC BY-NC 4.0."],
        ["Licensed under CC BY-NC 4.0."],
    ],
    "CC0": [
        ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "SPDX-License-Identifier: CC0-1.0"],
        ["CC0 1.0 Universal", "Released into the public domain."],
        ["Released into the public domain under CC0 1.0."],
    ],
    "CC-BY-NC-SA": [
        ["This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-SA-4.0"],
        ["This work is licensed under CC BY-NC-SA 4.0."],
        ["Licensed under CC BY-NC-SA 4.0."],
    ],
    "CC-BY-ND": [
        ["This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "SPDX-License-Identifier: CC-BY-ND-4.0"],
        ["This work is licensed under CC BY-ND 4.0."],
        ["Licensed under CC BY-ND 4.0."],
    ],
    "AGPL": [
        ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "You should have received a copy of the GNU Affero General Public License along with this program. If not, see http://www.gnu.org/licenses/"],
        ["SPDX-License-Identifier: AGPL-3.0-or-later", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3"],
        ["Licensed under the GNU Affero General Public License, version 3."],
    ],
    "EPL": [
        ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
        ["SPDX-License-Identifier: EPL-2.0", "Eclipse Public License - v 2.0"],
        ["Licensed under the Eclipse Public License 2.0."],
    ],
    "ISC": [
        ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
        ["SPDX-License-Identifier: ISC", "ISC License"],
        ["Licensed under the ISC License."],
    ],
    "Boost": [
        ["Distributed under the Boost Software License, Version 1.0.", "See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt"],
        ["SPDX-License-Identifier: BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003"],
        ["Licensed under the Boost Software License 1.0."],
    ],
    "Unlicense": [
        ["This is free and unencumbered software released into the public domain.", "For more information, please refer to https://unlicense.org"],
        ["SPDX-License-Identifier: Unlicense", "The Unlicense"],
        ["Released under the Unlicense."],
    ],
    "Proprietary": [
        ["All rights reserved. Unauthorized copying of this file is strictly prohibited.", "Proprietary and confidential.", "This software is proprietary and confidential."],
        ["Copyright. All rights reserved.", "All rights reserved."],
        ["Copyright by the author, all rights reserved."],
    ],
}
#: Short names of the families.
NAMES = {
    "Apache": ["Apache", "Apache 2", "Apache 2.0", "Apache License 2.0", "ASL 2.0"],
    "MIT": ["MIT", "MIT/X11", "Expat"],
    "GPL": ["GPL", "GPLv2", "GPLv3", "GPL v3", "GPL 2", "GPL-2.0", "GPL-3.0", "GPL-3.0-only", "GNU GPL", "GNU GPL v2", "GNU GPLv3", "GNU General Public License"],
    "LGPL": ["LGPL", "LGPLv2", "LGPLv3", "LGPL-2.1", "LGPL-3.0-or-later", "GNU LGPL", "GNU LGPL v3", "GNU Lesser General Public License"],
    "BSD": ["BSD", "BSD-2-Clause", "BSD-3-Clause", "3-clause BSD", "new BSD", "simplified BSD"],
    "MPL": ["MPL", "MPL 2.0", "MPLv2", "Mozilla Public License"],
    "CC-BY": ["CC BY", "CC-BY-4.0", "CC BY 3.0", "Creative Commons Attribution", "Creative Commons Attribution 4.0"],
    "CC-BY-SA": ["CC BY-SA", "CC-BY-SA-4.0", "CC BY-SA 3.0", "Creative Commons Attribution-ShareAlike"],
    "CC-BY-NC": ["CC BY-NC", "CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial"],
    "CC-BY-NC-SA": ["CC BY-NC-SA", "CC-BY-NC-SA-4.0", "Creative Commons Attribution-NonCommercial-ShareAlike"],
    "CC-BY-ND": ["CC BY-ND", "CC-BY-ND-4.0", "Creative Commons Attribution-NoDerivatives"],
    "CC0": ["CC0", "CC0 1.0", "CC0-1.0"],
    "AGPL": ["AGPL", "AGPLv3", "AGPL-3.0", "GNU AGPL", "GNU AGPLv3", "GNU Affero General Public License"],
    "EPL": ["EPL", "EPL-2.0", "EPL 1.0", "Eclipse Public License"],
    "ISC": ["ISC"],
    "Boost": ["BSL-1.0", "Boost Software License", "Boost License"],
    "Unlicense": ["Unlicense"],
}
#: What stands around a short name where it is a licence; the last two are held out of the fit.
PHRASES = ["{}", "license: {}", "licence: {}", "{} license", "{} licence", "{} licensed", "licensed under {}", "under {}", "license {}", "the {} license for"]
#: Short names that are words of other things too and stand for a licence only in a phrase.
AMBIGUOUS = frozenset(["Apache", "MIT", "Expat", "BSD", "ISC"])


def _named(family: str, phrases: list[str]) -> list[str]:
    return list(dict.fromkeys(phrase.format(name) for name in NAMES.get(family, []) for phrase in phrases if phrase != "{}" or name not in AMBIGUOUS))


TEMPLATES = {family: [s for notice in notices for s in notice] + _named(family, PHRASES) for family, notices in NOTICES.items()}
#: Words of licences: a feature holds one of them, and a paragraph without any has no feature.
ANCHORS = frozenset("license licenses licensed licence licenced sublicense spdx apache mit gnu gpl lgpl bsd mpl mozilla copyright cc cc0 commons attribution noncommercial sharealike redistribute redistribution redistributions hereby granted reserved proprietary unencumbered domain endorse waived warranties clause gplv2 gplv3 lgplv2 lgplv3 agpl agplv3 mplv2 epl isc asl bsl expat unlicense affero noderivatives".split())
NEGATIVES = [
    "A driver needs a licence to drive a car in this town.", "The hotel has a liquor license and a public bar.", "Apache helicopters flew over the free city.", "He lost his fishing license in the source of the river.",
    "The mit of the hand was cold.", "The rights of the people are reserved by law.", "Copyright law is a subject taught at this school.", "She asked permission to copy the source.", "The general public enjoyed the work.",
    "A creative group of commons members met.", "The public domain of the king was under water.", "Her license plate was version 3 of the design.", "Redistribution of land was under way.", "The gnu grazed under the tree.",
    "Her poetic license was version two of a creative common work.", "The House of Commons granted the request.", "A room was reserved for all of them.", "The patent was granted and the domain registered.", "I hereby declare that the meeting is open.",
    "The company sells proprietary tools under many brands.", "The license fee was paid to the office on time.", "Warranties are given for two years in that country.", "He waived his right to speak and left.", "A clause of the contract was disputed.",
    "The expat moved under the bridge for the summer.", "The isc of the town met on Monday.", "She got a boost from the eclipse of the moon.", "Under the apache rule of the valley the people were free.", "His cc of the letter went to the office.",
    "He studied at MIT for two years.", "The Apache scouts rode over the hill.", "Work at MIT and at the Apache reservation went on.",
]
UNKNOWN, LEAST, OVERLAP, TRAIN_PARAGRAPHS, SHORT = "unknown", 0.6, 0.5, 500, 7
_WORD = r"[\p{L}\p{N}]+(?:\.[0-9]+)?"
_PYTHON_WORD = re.compile(r"[^\W_]+(?:\.[0-9]+)?")
#: A paragraph ends here: behind a line that ends a sentence, and at lines without a letter or digit.
BREAK = r"(?<=[.!?:;])[\x20\t\r]*\n|\n(?:[^\p{L}\p{N}\n]*\n)+"


def words(text: str) -> list[str]:
    return _PYTHON_WORD.findall(text.lower())


def ngrams(found: list[str]) -> set[str]:
    return {" ".join(found[k : k + n]) for n in (1, 2, 3, 4) for k in range(len(found) - n + 1)}


def pairs(found: list[str]) -> list[str]:
    """The neighbours in a text; of a single word the word."""
    return sorted({" ".join(p) for p in zip(found, found[1:])} or set(found))


def _examples(notices: dict[str, list[str]], negatives: list[str], seed: int) -> list[tuple[list[str], str]]:
    """Sentences whole, with words left out and inside other words; then the unknown ones."""
    rng = random.Random(seed)
    other = [w for t in negatives for w in words(t) if w not in ANCHORS]
    rows = []
    for family, templates in notices.items():
        for t in templates:
            w = words(t)
            rows.append((w, family))
            for _ in range(4):
                # A short name without one of its words may be another family's.
                kept = [x for x in w if len(w) <= SHORT or rng.random() > 0.12]
                around = [rng.choice(other) for _ in range(rng.randrange(12))]
                cut = rng.randrange(len(around) + 1)
                rows.append((around[:cut] + kept + around[cut:], family))
    rows += [(words(t), UNKNOWN) for t in negatives for _ in range(3 if ANCHORS & set(words(t)) else 1)]
    every = sorted({x for t in notices.values() for s in t for x in words(s)})
    for _ in range(120):  # licence words in no order, and other words among them
        rows.append(([rng.choice(every if rng.random() < 0.3 else other) for _ in range(rng.randrange(4, 20))], UNKNOWN))
    return rows


class Classifier:
    """families, bias of each, weights of n-grams by family and a temperature."""

    def __init__(self, negatives: list[str], seed: int = 3):
        negatives = [*NEGATIVES, *negatives]
        self.families = [*TEMPLATES, UNKNOWN]
        fit = {family: [s for notice in notices[:-1] for s in notice] + _named(family, PHRASES[:-2]) for family, notices in NOTICES.items()}
        held = {family: notices[-1] + _named(family, PHRASES[-2:]) for family, notices in NOTICES.items()}
        self.vocabulary = sorted({g for templates in TEMPLATES.values() for t in templates for g in ngrams(words(t)) if ANCHORS & set(g.split())})
        self.place = {g: k for k, g in enumerate(self.vocabulary)}
        self._fit(_examples(fit, negatives[::2] + NEGATIVES, seed))
        self.held = _examples(held, negatives[1::2], seed + 1)
        self.found = [self.predict(" ".join(w))[0] for w, _ in self.held]  # what the fit says of notices it has not seen
        self._calibrate([(self._vector(w), self.families.index(f)) for w, f in self.held])
        temperature = self.temperature
        self._fit(_examples(TEMPLATES, negatives, seed))  # the calibrated temperature, and all notices
        self.temperature = temperature
        assert self.bias[-1] == max(self.bias), "a paragraph without a feature must be unknown"

    def _vector(self, found: list[str]) -> list[int]:
        return sorted(self.place[g] for g in ngrams(found) if g in self.place)

    def scores(self, x: list[int]) -> list[float]:
        """Weights are divided by the square root of their number, so that long and short notices speak as loud."""
        size = math.sqrt(max(1, len(x)))
        return [b + sum(self.weights[k][f] for k in x) / size for f, b in enumerate(self.bias)]

    def _probabilities(self, scores: list[float]) -> list[float]:
        top = max(scores)
        e = [math.exp((s - top) / self.temperature) for s in scores]
        return [v / sum(e) for v in e]

    def predict(self, text: str) -> tuple[str, float]:
        p = self._probabilities(self.scores(self._vector(words(text))))
        return max(zip(p, self.families), key=lambda x: x[0])[::-1]

    def _fit(self, examples: list[tuple[list[str], str]], rounds: int = 15, rate: float = 1.0, shrink: float = 1e-4) -> None:
        rng, rows = random.Random(0), [(self._vector(w), self.families.index(f)) for w, f in examples]
        self.weights = [[0.0] * len(self.families) for _ in self.vocabulary]
        self.bias, self.temperature = [0.0] * (len(self.families) - 1) + [1.0], 1.0  # nothing known: unknown
        for r in range(rounds):
            rng.shuffle(rows)
            step = rate / (1 + 0.2 * r)
            for x, y in rows:
                size = math.sqrt(max(1, len(x)))
                for f, p in enumerate(self._probabilities(self.scores(x))):
                    g = step * (p - (f == y))
                    if not x:
                        self.bias[f] -= 0.1 * g
                    elif abs(g) > 1e-4:
                        for k in x:
                            self.weights[k][f] -= g / size + step * shrink * self.weights[k][f]

    def _calibrate(self, rows: list[tuple[list[int], int]]) -> None:
        scored = [(self.scores(x), y) for x, y in rows]

        def loss(t: float) -> float:
            self.temperature = t
            return -sum(math.log(max(1e-12, self._probabilities(s)[y])) for s, y in scored)

        self.temperature = min((0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8), key=loss)


def _tokens(paragraph: Column) -> Column:
    return F.regexp_extract_all(F.lower(paragraph), F.lit(_WORD), F.lit(0))


def _ngrams(found: str) -> Column:
    n = F.size(found)

    def from_each(k: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.when(i + k - 1 <= n, F.array_join(F.slice(found, i, k), " ")))

    return F.array_distinct(F.concat(*map(from_each, (1, 2, 3, 4))))


def has_anchor(text: Column) -> Column:
    """Whether a text may hold an anchor word: each of them holds one of these strings, the short ones only as words."""
    lowered = F.lower(text)
    out = lowered.rlike(rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(sorted(a for a in ANCHORS if len(a) < 5))})(?![\p{{L}}\p{{N}}])")
    for part in LONG_PARTS:
        out = out | lowered.contains(part)
    return out


#: Parts of the longer anchors; the shortest anchors of which the others are longer forms.
LONG_PARTS = sorted(a for a in ANCHORS if len(a) >= 5 and not any(b != a and b in a for b in ANCHORS if len(b) >= 5))


def paragraphs(docs: DataFrame) -> DataFrame:
    """Those that hold an anchor, as doc_id, at (unique by row and paragraph), paragraph (its number, from 0), found (words)."""
    some = docs.select("doc_id", "text").where(has_anchor(F.col("text")))
    parts = some.select("doc_id", F.posexplode(F.split("text", BREAK)).alias("paragraph", "body")).where(has_anchor(F.col("body")))
    return parts.select("doc_id", "paragraph", _tokens(F.col("body")).alias("found")).withColumn("at", F.monotonically_increasing_id())


def license_scan(docs: DataFrame, least: float = LEAST, overlap: float = OVERLAP, train_paragraphs: int = TRAIN_PARAGRAPHS) -> DataFrame:
    """(doc_id, text) -> doc_id, paragraph, family, probability, template_overlap: a row for each licence paragraph.

    Paragraphs are numbered from 0. Families whose probability is below ``least``,
    or whose nearest template shares less than ``overlap`` of its pairs of words
    with the paragraph, are unknown and give no row, as do null and empty texts.
    The unknown class is also fitted on the first paragraphs of about
    ``train_paragraphs`` documents, drawn by hash, that hold no anchor. Repeated
    rows are each scanned; other columns are ignored; an empty table gives no rows.
    """
    first = drawn(docs, train_paragraphs, "doc_id").select(F.substring_index("text", "\n", 1).alias("line"))
    unknown = first.where((F.length("line") < 400) & ~has_anchor(F.col("line"))).distinct().collect()
    model = Classifier(sorted(r["line"] for r in unknown))
    spark = docs.sparkSession
    held = durable(paragraphs(docs))
    weights = spark.createDataFrame([(g, w) for g, w in zip(model.vocabulary, model.weights)], "gram string, weights array<double>")
    templates = [(p, family, k, 1.0 / len(pairs(words(t)))) for family, ts in TEMPLATES.items() for k, t in enumerate(ts) for p in pairs(words(t))]
    templates = spark.createDataFrame(templates, "gram string, family string, template int, share double")

    grams = held.select("at", F.explode(_ngrams("found")).alias("gram")).where("gram is not null")
    hits = grams.join(F.broadcast(weights), "gram")
    sums = [F.sum(F.get("weights", F.lit(f))) for f in range(len(model.families))]
    size = F.sqrt(F.count(F.lit(1)))
    scored = hits.groupBy("at").agg(F.array(*(F.lit(b) + s / size for b, s in zip(model.bias, sums))).alias("scores"))
    top = F.array_max("scores")
    total = F.aggregate("scores", F.lit(0.0), lambda s, v: s + F.exp((v - F.col("top")) / model.temperature))
    family = F.array(*map(F.lit, model.families))[(F.array_position("scores", F.col("top")) - 1).cast("int")]
    named = scored.withColumn("top", top).select("at", family.alias("family"), (F.lit(1.0) / total).alias("probability"))
    named = named.where((F.col("family") != UNKNOWN) & (F.col("probability") >= least))
    met = grams.join(F.broadcast(templates), "gram").join(named, ["at", "family"])
    shares = met.groupBy("at", "family", "template").agg(F.sum("share").alias("share"), F.first("probability").alias("probability"))
    nearest = shares.groupBy("at", "family").agg(F.max("share").alias("share"), F.first("probability").alias("probability")).where(F.col("share") >= overlap - 1e-9)
    found = held.select("at", "doc_id", "paragraph").join(nearest, "at")
    return found.select("doc_id", "paragraph", "family", F.round("probability", 4).alias("probability"), F.round("share", 4).alias("template_overlap"))
