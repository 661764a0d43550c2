"""Licence scan: a trained paragraph classifier over sparse word n-grams.

Softmax regression over words and word pairs, trained here on the driver with a
fixed seed: examples are notices, long parts of them, the families' names in
many wordings, and sentences about other things.  Wordings and sentences are
split into those that are learned from and those that are kept back, which set
the temperature, so that the class "unknown" is calibrated on wordings that were
not learned.  A prediction stands only if the text also shares enough word pairs
with a notice or a name of that family.

The main path is one projection of DataFrame functions, without any shuffle:
texts are cut into paragraphs with their lines joined, into their sentences, and
once more line by line.  Words and pairs are found by hash in a table with two
places for each.  A paragraph that shares no telling pair with any notice or
name holds no part that could stand whatever its scores; only such paragraphs,
and such parts of the others, are left unscored.
"""

from __future__ import annotations

import json
import re
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNKNOWN = "unknown"
#: Notices by licence family.
TEMPLATES = {
    "agpl": [
        "If you modify the Program, your modified version must prominently offer all users interacting with it remotely through a computer network an opportunity to receive the Corresponding Source; see the GNU Affero General Public License.",
        "This program is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ],
    "apache": [
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements.",
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "bsd": [
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
        "Released under the BSD License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ],
    "gpl": [
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "isc": [
        "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "SPDX-License-Identifier: ISC",
    ],
    "lgpl": [
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY. See the GNU Lesser General Public License for more details.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
        "This library is licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "mit": [
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
    ],
    "mpl": [
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/ (Mozilla Public License).",
        "Licensed under the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "proprietary": [
        "Copyright by the publisher. All rights reserved worldwide.",
        "Unauthorized copying of this file, via any medium, is strictly prohibited; proprietary and confidential.",
        "No part of this publication may be reproduced, stored or transmitted in any form without the prior permission of the publisher.",
        "All rights reserved.",
        "This document is confidential and proprietary; no part of it may be reproduced or distributed without prior written permission of the copyright holder.",
    ],
    "public-domain": [
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, for any purpose, commercial or non-commercial; it is in the public domain.",
        "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law.",
        "This work is released into the public domain.",
        "This is free and unencumbered software released into the public domain.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0 Universal.",
        "SPDX-License-Identifier: CC0-1.0",
    ],
    "artistic": [
        "Licensed under the Artistic License 2.0.",
        "This program is free software; you can redistribute it and/or modify it under the same terms as Perl itself, either the GNU General Public License or the Artistic License.",
        "SPDX-License-Identifier: Artistic-2.0",
    ],
    "boost": [
        "Distributed under the Boost Software License, Version 1.0.",
        "See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use, reproduce, display, distribute, execute, and transmit the Software.",
        "SPDX-License-Identifier: BSL-1.0",
    ],
    "cc-by-nd": [
        "Licensed under CC BY-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-ND-4.0",
    ],
    "cddl": [
        "The contents of this file are subject to the terms of the Common Development and Distribution License.",
        "You can obtain a copy of the license at usr/src/OPENSOLARIS.LICENSE or under the CDDL.",
        "SPDX-License-Identifier: CDDL-1.0",
    ],
    "epl": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
        "Licensed under the Eclipse Public License, version 1.0.",
        "SPDX-License-Identifier: EPL-2.0",
    ],
    "eupl": [
        "Licensed under the EUPL, Version 1.2 or, as soon they will be approved by the European Commission, subsequent versions of the EUPL (the Licence).",
        "Licensed under the European Union Public Licence.",
        "SPDX-License-Identifier: EUPL-1.2",
    ],
    "ofl": [
        "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
        "SPDX-License-Identifier: OFL-1.1",
    ],
    "wtfpl": [
        "This program is free software. It comes without any warranty; you can redistribute it under the terms of the Do What The Fuck You Want To Public License.",
        "SPDX-License-Identifier: WTFPL",
    ],
    "zlib": [
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions.",
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "SPDX-License-Identifier: Zlib",
    ],
}
#: Sentences with cue words that grant nothing.
OTHER = [
    "The driver had to show a valid license at the border.",
    "She renewed her fishing license in the spring.",
    "A license for the radio station was granted by the ministry.",
    "The new version of the program was released in March.",
    "The court decided a copyright case between two publishers.",
    "Copyright law differs from country to country.",
    "The warranty of the machine covers parts and labour for two years.",
    "The public library is open from nine to five.",
    "Permission to enter the building must be asked at the desk.",
    "He took the licence with words that poets are used to.",
    "Their domain is public health and the use of clean water.",
    "The foundation gave free copies of the book to schools.",
    "The general told the public about the terms of the agreement.",
    "Software of this kind is used in hospitals and in banks.",
    "They reserved all the rooms of the hotel for the conference.",
    "Distribution of the leaflets was forbidden without a licence from the mayor.",
    "A dog licence costs five pounds a year in this town.",
    "Rights and duties of tenants are listed in the second part.",
    "No part of the city was without water during the repair.",
    "The author published the work under a false name.",
]
#: Names of the families.
NAMES = {
    "agpl": ["GNU Affero General Public License", "Affero GPL", "GNU AGPL", "AGPL", "AGPLv3", "AGPL-3.0"],
    "apache": ["Apache License", "Apache Software License", "Apache 2.0", "Apache-2.0", "Apache License 2.0", "Apache License, Version 2.0"],
    "artistic": ["Artistic License", "Perl Artistic License", "Artistic-2.0"],
    "boost": ["Boost Software License", "Boost License", "BSL-1.0"],
    "bsd": ["BSD License", "3-clause BSD license", "2-clause BSD license", "New BSD License", "Simplified BSD License", "Modified BSD License", "BSD-style license", "BSD-3-Clause", "BSD-2-Clause"],
    "cc-by": ["CC BY 4.0", "CC-BY-4.0", "CC BY 3.0", "CC BY", "Creative Commons Attribution 4.0 International", "Creative Commons Attribution License"],
    "cc-by-nc": ["CC BY-NC 4.0", "CC-BY-NC-4.0", "CC BY-NC", "CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial 4.0 International", "Creative Commons Attribution-NonCommercial-ShareAlike License"],
    "cc-by-nd": ["CC BY-ND 4.0", "CC-BY-ND-4.0", "CC BY-ND", "Creative Commons Attribution-NoDerivatives 4.0 International", "Creative Commons Attribution-NoDerivs License"],
    "cc-by-sa": ["CC BY-SA 4.0", "CC-BY-SA-4.0", "CC BY-SA 3.0", "CC BY-SA", "Creative Commons Attribution-ShareAlike 4.0 International", "Creative Commons Attribution-ShareAlike License"],
    "cddl": ["Common Development and Distribution License", "CDDL", "CDDL-1.0"],
    "epl": ["Eclipse Public License", "Eclipse Public License 2.0", "EPL-2.0", "EPL 1.0", "EPL"],
    "eupl": ["European Union Public Licence", "European Union Public License", "EUPL", "EUPL-1.2"],
    "gpl": ["GNU General Public License", "GNU GPL", "GPL", "GPLv2", "GPLv3", "GPL-3.0", "GPL-2.0-only", "GPL-3.0-or-later", "General Public License"],
    "isc": ["ISC License", "ISC licence", "ISC"],
    "lgpl": ["GNU Lesser General Public License", "GNU LGPL", "LGPL", "LGPLv2.1", "LGPLv3", "LGPL-2.1", "Lesser GPL", "GNU Library General Public License"],
    "mit": ["MIT License", "MIT licence", "MIT/X11 license", "Expat License", "X11 License"],
    "mpl": ["Mozilla Public License", "MPL 2.0", "MPL-2.0", "MPL", "Mozilla Public License 2.0"],
    "ofl": ["SIL Open Font License", "Open Font License", "OFL-1.1"],
    "public-domain": ["Unlicense", "CC0", "CC0 1.0 Universal", "CC0-1.0", "Creative Commons Zero", "public domain dedication"],
    "wtfpl": ["WTFPL", "Do What The Fuck You Want To Public License"],
    "zlib": ["zlib license", "zlib/libpng license"],
}
#: Wordings around a name.  Each fifth is only tested with, and each fifth after it only calibrates.
FRAMES = [
    "Licensed under the {}.",
    "Released under the {}.",
    "This project is distributed under the terms of the {}.",
    "The source code is available under {}.",
    "{}",
    "License: {}",
    "This software is licensed under {}; see the LICENSE file for details.",
    "You may use, copy and change it under the {} or any later version.",
    "It is published under the {} license.",
    "The library is free software, made available under the {}.",
    "All code in this repository is covered by the {}.",
    "Permission to use these files is given by the {}.",
    "The text of this article is available under the {}.",
    "This work is licensed under a {}.",
    "Foo is distributed under {} or later.",
    "The terms of the {} apply to this package.",
    "Dual licensed: this part is under the {}.",
    "Copyright 2019 The Authors, {}.",
    "Contributions are accepted under the {}.",
    "The program may be redistributed under the terms of the {}.",
    "Use is governed by the {}.",
    "SPDX-License-Identifier: {}",
    "These data are offered under {}, version 2.",
    "This module is under {}.",
    "Our images are released with a {}.",
    "Dedicated under {}.",
    "Available under {}.",
    "Distributed under the terms of the {} v3.",
]
#: From these, sentences are put together that grant nothing; the last list names things that share words with the families' names.
THINGS = ["driving", "fishing", "hunting", "radio", "dog", "pilot", "marriage", "taxi", "liquor", "trade", "television", "building", "hairdresser's", "software"]
ABOUT = [
    "She renewed her {} license in the spring.",
    "A {} licence costs twenty pounds a year in this town.",
    "The office refused him a {} license under the new law.",
    "The terms of a {} licence are printed on the back.",
    "You may not work without a valid {} license.",
    "The {} license was released to the public by the ministry.",
    "Copies of the {} licence must be kept for three years.",
    "Under the terms of the contract the {} licence ends in May.",
]
ASIDES = [
    "He studied at MIT and later moved to Boston.",
    "The Apache helicopter landed behind the hills.",
    "The Apache people lived in the southwest.",
    "Mozilla released a new version of its browser.",
    "The eclipse was seen by the public across Europe.",
    "Creative Commons held a conference in the city.",
    "The BSD system ran on old machines.",
    "The GNU project was founded by a programmer.",
    "A gnu is a large antelope of the open plains.",
    "An artistic work may be copied for private use.",
    "The European Union agreed on a public budget.",
    "A boost to software sales came from the new phone.",
    "The general public was not told of the agreement.",
    "The public license office is open on Mondays.",
    "The common development of the valley took ten years.",
    "Lesser known writers publish their work without permission.",
    "The open font on the sign was hard to read.",
    "General terms and conditions apply to the sale.",
    "The attribution of the painting is not certain.",
    "The commons were used by all farmers of the village.",
    "Version 2.0 of the report was sent to the board.",
    "Anyone is free to visit the garden on Sunday.",
    "The warranty does not cover damage by water.",
    "Any person may obtain a copy of the report from the office.",
    "Use of the hall is subject to the following conditions.",
    "The software is provided on a disc with the book.",
    "The following conditions are met in every case.",
    "The above notice must be displayed at the door.",
    "He has waived his rights to the house.",
    "All rights of way are shown on the map.",
    "The copyright of the song belongs to the band.",
    "Permission was granted by the owner of the land.",
    "The work was dedicated to his mother.",
    "It is distributed in the north of the country.",
    "The materials are available at the library.",
    "Part of the building may not be used in winter.",
    "She asked for a copy of the terms of the loan.",
    "The distribution of water is governed by the council.",
    "Commercial use of the river is forbidden.",
    "The author is liable for damages under this law.",
]
#: A part with one of these is reported even if no family is found in it; it decides nothing else.
CUES = r"licen[cs]|copyright|all rights reserved|public domain|redistribut|permission|proprietary|mozilla public|warrant"
PARAGRAPH = r"\n[\x20\x09]*\n\s*"
SENTENCE = r"\n+|(?<=[.!?])[\x20\x09]+(?=\p{Lu})"
TOKEN = r"[\p{L}\p{N}]+"
#: Words that make no pair with each other that would count as shared with a notice.
PLAIN = "a all and any are as at be by for from has in is it may no not of on or other that the this to under with you".split()
VERSION = r"(?:version[ \t]+|licen[cs]e[, \t]+|\bv\.?[ \t]*|gpl[- v]*|mpl[- v]*|epl[- v]*|apache[- ]|(?:by|sa|nc|nd|cc0|international|[a-z])[- \t]+)([0-9]+(?:\.[0-9]+)*)"
#: Least probability, and least share of a template's or the part's word pairs, for a prediction to stand.
LEAST_PROBABILITY, LEAST_OVERLAP = 0.5, 0.5
SEED = 7


def tokens(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def grams(words: list[str]) -> list[str]:
    return list(dict.fromkeys([*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))]))


def telling(words: list[str]) -> list[str]:
    """The word pairs that count for a comparison: not of two plain words; a single word counts itself."""
    if len(words) == 1:
        return words
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False) if not (a in PLAIN and b in PLAIN)))


def examples() -> tuple[list, list, list]:
    """(learned, calibrating, testing) examples as (family, words), split by wording and sentence, never by variant."""
    rng = np.random.default_rng(SEED)
    parts: tuple[list, list, list] = ([], [], [])
    side = lambda k: {3: 1, 4: 2}.get(k % 5, 0)
    for family, notices in TEMPLATES.items():
        for notice in notices:
            words = tokens(notice)
            for k in range(6):
                size = len(words) if k == 0 or len(words) <= 8 else int(rng.integers(max(6, len(words) // 2), len(words) + 1))
                at = int(rng.integers(0, len(words) - size + 1))
                around = tokens(OTHER[int(rng.integers(len(OTHER)))]) if k % 2 else []
                parts[0].append((family, [*around[: int(rng.integers(0, 6))], *words[at : at + size], *around[: int(rng.integers(0, 6))]]))
    for family, names in NAMES.items():
        for n, name in enumerate(names):
            for f, frame in enumerate(FRAMES):
                if f % 5 in (3, 4) or (f + n) % 2 == 0:  # half of the learned wordings for each name
                    parts[side(f)].append((family, tokens(frame.format(name))))
    sentences = [*OTHER, *ASIDES, *(about.format(x) for k, about in enumerate(ABOUT) for x in THINGS[k % 2 :: 2])]
    for k, sentence in enumerate(sentences):
        words = tokens(sentence)
        for j in range(3):
            size = int(rng.integers(3, len(words) + 1)) if j else len(words)
            at = int(rng.integers(0, len(words) - size + 1))
            parts[side(k)].append((UNKNOWN, words[at : at + size]))
    # wordings without a name grant nothing that could be told
    for f, frame in enumerate(FRAMES):
        for noun in ("", "terms below", "conditions of the owner", "law of the country", "Acme Corporate License", "house rules"):
            parts[side(f)].append((UNKNOWN, tokens(frame.format(noun))))
    return parts


@cache
def train() -> dict:
    """{classes, bias, weights: gram -> row}; the same every time."""
    learned, kept, _ = examples()
    classes = [UNKNOWN, *sorted(TEMPLATES)]
    index: dict[str, int] = {}
    for _, words in learned:
        for g in grams(words):
            index.setdefault(g, len(index))

    def matrix(rows):
        x = np.zeros((len(rows), len(index)), np.float32)
        for i, (_, words) in enumerate(rows):
            x[i, [index[g] for g in grams(words) if g in index]] = 1
        return x, np.array([classes.index(c) for c, _ in rows])

    x, y = matrix(learned)
    truth = np.eye(len(classes), dtype=np.float32)[y]
    # every class weighs the same, "unknown" three times as much
    weight = (1 / np.bincount(y, minlength=len(classes))[y]) * np.where(y == 0, 3, 1)
    weight = (weight / weight.sum()).astype(np.float32)[:, None]
    w, b = np.zeros((len(index), len(classes)), np.float32), np.zeros(len(classes), np.float32)
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(250):  # gradient steps with momentum
        z = x @ w + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        err = (p - truth) * weight
        vw = 0.9 * vw - 0.5 * (x.T @ err + 2e-5 * w)
        vb = 0.9 * vb - 0.5 * err.sum(axis=0)
        w, b = w + vw, b + vb
    kx, ky = matrix(kept)
    best = (np.inf, 1.0)
    for t in np.geomspace(0.25, 8, 41):  # temperature by the loss on wordings that were kept back
        z = (kx @ w + b) * t
        z -= z.max(axis=1, keepdims=True)
        loss = float(-(z[np.arange(len(ky)), ky] - np.log(np.exp(z).sum(axis=1))).mean())
        best = min(best, (loss, float(t)))
    w, b = np.round(w * best[1], 3).astype(float), np.round(b * best[1], 3).astype(float)
    return {"classes": classes, "bias": b.tolist(), "weights": {g: w[i].tolist() for g, i in index.items()}}


def predict(words: list[str]) -> tuple[str, float]:
    """Family and probability by the model, in plain Python."""
    model = train()
    z = np.array(model["bias"]) + sum((np.array(model["weights"][g]) for g in grams(words) if g in model["weights"]), np.zeros(len(model["classes"])))
    p = np.exp(z - z.max())
    return model["classes"][int(p.argmax())], float(p.max() / p.sum())


@cache
def shapes() -> dict[str, list[list[str]]]:
    """The telling pairs of every notice and name by family."""
    return {f: [s for s in (telling(tokens(t)) for t in [*TEMPLATES[f], *NAMES.get(f, ())]) if s] for f in TEMPLATES}


def gram_hash(gram: str) -> int:
    """Of a word its hash, of a pair both words' hashes crossed; as 64 bits without a sign."""
    import xxhash

    first, *second = (xxhash.xxh64_intdigest(w.encode(), 42) for w in gram.split(" "))
    return (first ^ (second[0] << 1)) & ((1 << 64) - 1) if second else first


class Table:
    """Rows of values found by the hash of a word or pair at one of two places, as array literals."""

    def __init__(self, rows: dict[str, object]):
        key = {gram_hash(k): v for k, v in rows.items()}
        self.size = 4 * len(key) + 17
        while True:
            at: dict[int, int] = {}
            if all(self._put(at, h) for h in key):
                break
            self.size += self.size // 8 + 1
        signed = lambda h: h - (1 << 64) if h >> 63 else h
        #: For every place the hash that lies there, and the number of its row from 1.
        self.hashes = [signed(at[i]) if i in at else 0 for i in range(self.size)]
        number = {h: n for n, h in enumerate(key, 1)}
        self.numbers = [number[at[i]] if i in at else 0 for i in range(self.size)]
        self.rows = list(key.values())

    def _places(self, h: int) -> tuple[int, int]:
        signed = h - (1 << 64) if h >> 63 else h
        return signed % self.size, (signed >> 21) % self.size

    def _put(self, at: dict[int, int], h: int) -> bool:
        place = self._places(h)[0]
        for _ in range(200):
            if at.get(place) is None:
                at[place] = h
                return True
            at[place], h = h, at[place]
            a, b = self._places(h)
            place = b if place == a else a
        return False

    def lookup(self):
        """A function: column of a gram's hash -> number of its row, 0 if it has none."""
        hashes, numbers = (F.from_json(F.lit(json.dumps(x)), t) for x, t in ((self.hashes, "array<bigint>"), (self.numbers, "array<int>")))
        place = lambda h: F.pmod(h, F.lit(self.size)).cast("int")

        def find(h):
            first, second = place(h), place(F.shiftright(h, 21))
            return F.when(hashes[first] == h, numbers[first]).when(hashes[second] == h, numbers[second]).otherwise(F.lit(0))

        return find


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: doc_id, n_candidates, n_confirmed, families, licence, confidence and matches.

    ``matches`` holds text, family, probability, overlap and version of every
    candidate: a part (paragraph, sentence or line) with a cue word, or one that the classifier gives to a
    family with enough probability.  A part inside a longer candidate of the
    same family and standing is left out.  ``families`` are the confirmed families in
    code point order; ``licence`` is the confirmed family of the highest
    probability (ties: first by name), ``unknown`` if none is confirmed but there
    is a candidate, else ``none``.  A null or empty text has no parts; texts of
    any length are read whole; rows with equal or null ids are scanned each on
    its own; other columns are not read; an empty table gives an empty result.
    """
    model = train()
    literal = lambda x, t: F.from_json(F.lit(json.dumps(x)), t)
    bias, classes = literal(model["bias"], "array<double>"), literal(model["classes"], "array<string>")
    known = Table(model["weights"])
    number, rows = known.lookup(), literal(known.rows, "array<array<double>>")
    templates = literal(shapes(), "map<string,array<array<string>>>")
    telling_grams = sorted({p for own in shapes().values() for s in own for p in s})
    shared = Table({p: 1 for p in telling_grams}).lookup()
    # the first words of telling pairs, and the words that tell alone: most paragraphs have none, which is soon seen
    opening = Table({p.split(" ")[0]: 1 for p in telling_grams}).lookup()
    plain = F.array(*[F.lit(x) for x in PLAIN])

    def cut(part):
        words = F.regexp_extract_all(F.lower(part), F.lit(f"({TOKEN})"), 1)
        return F.struct(part.alias("text"), words.alias("words"), F.transform(words, lambda w: F.xxhash64(w)).alias("hashes"))

    def crossed(hashes):
        most = F.greatest(F.size(hashes) - 1, F.lit(1))
        two = F.zip_with(F.slice(hashes, 1, most), F.slice(hashes, 2, most), lambda a, b: a.bitwiseXOR(F.shiftleft(b, 1)))
        return F.when(F.size(hashes) > 1, two).otherwise(F.array().cast("array<bigint>"))

    def hopeful(c):
        found = F.exists(crossed(c["hashes"]), lambda h: shared(h) > 0) | F.exists(c["hashes"], lambda h: shared(h) > 0)
        return F.when(F.exists(c["hashes"], lambda h: opening(h) > 0), found).otherwise(F.lit(False))

    cued = lambda c: F.lower(c["text"]).rlike(CUES)
    text = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"\r\n?", "\n")
    out = df.select(F.col(id_col).alias("doc_id"), F.transform(F.split(text, PARAGRAPH), cut).alias("_paragraphs"))
    # the pairs of every sentence and line of a paragraph are pairs of the paragraph, so none that could stand is lost
    out = out.withColumn("_some", F.transform(F.filter("_paragraphs", lambda c: cued(c) | hopeful(c)), lambda c: c["text"]))

    def parts(raw):
        joined = F.trim(F.regexp_replace(raw, r"\n+", " "))
        return F.concat(F.array(joined), F.split(joined, SENTENCE), F.when(F.instr(raw, "\n") > 0, F.split(raw, SENTENCE)).otherwise(F.array().cast("array<string>")))

    out = out.withColumn("_cut", F.transform(F.array_distinct(F.flatten(F.transform("_some", parts))), cut))
    out = out.withColumn("_two", F.transform(F.filter("_cut", lambda c: cued(c) | hopeful(c)), lambda c: F.struct(c["text"].alias("text"), c["words"].alias("words"), c["hashes"].alias("hashes"), cued(c).alias("cue"))))

    def logits(c):
        own = F.filter(F.transform(F.array_distinct(F.concat(c["hashes"], crossed(c["hashes"]))), number), lambda k: k > 0)
        z = F.aggregate(own, bias, lambda acc, k: F.zip_with(acc, rows[k - 1], lambda a, b: a + b))
        words, most = c["words"], F.greatest(F.size(c["words"]) - 1, F.lit(1))
        two = F.when(F.size(words) > 1, F.zip_with(F.slice(words, 1, most), F.slice(words, 2, most), lambda a, b: F.when(~(F.array_contains(plain, a) & F.array_contains(plain, b)), F.concat_ws(" ", a, b)))).otherwise(F.array().cast("array<string>"))
        tell = F.array_distinct(F.array_compact(two))
        return F.struct(c["text"].alias("text"), F.array_distinct(F.concat(tell, words)).alias("own"), F.greatest(F.size(tell), F.lit(1)).alias("size"), c["cue"].alias("cue"), z.alias("z"))

    out = out.withColumn("_z", F.transform("_two", logits))

    def softmax(c):
        top = F.array_max(c["z"])
        total = F.aggregate(c["z"], F.lit(0.0), lambda acc, z: acc + F.exp(z - top))
        return F.struct(c["text"].alias("text"), c["own"].alias("own"), c["size"].alias("size"), c["cue"].alias("cue"), classes[F.array_position(c["z"], top).cast("int") - 1].alias("family"), (F.lit(1.0) / total).alias("probability"))

    likely = lambda c: (c["family"] != UNKNOWN) & (c["probability"] >= LEAST_PROBABILITY)
    out = out.withColumn("_p", F.filter(F.transform("_z", softmax), lambda c: c["cue"] | likely(c)))

    def confirmed(c):
        agree = F.transform(F.coalesce(templates[c["family"]], F.array()), lambda t: F.size(F.array_intersect(t, c["own"])) / F.least(F.size(t), c["size"]))
        overlap = F.least(F.coalesce(F.array_max(agree), F.lit(0.0)), F.lit(1.0))
        version = F.regexp_extract(F.lower(c["text"]), VERSION, 1)
        return F.struct(c["text"].alias("text"), c["family"].alias("family"), F.round(c["probability"], 6).alias("probability"), F.round(overlap, 6).alias("overlap"), F.when(version != "", version).alias("version"))

    stands = lambda m: likely(m) & (m["overlap"] >= LEAST_OVERLAP)
    inside = lambda m, o: (o["family"] == m["family"]) & (stands(o) == stands(m)) & (F.length(o["text"]) > F.length(m["text"])) & F.contains(o["text"], m["text"])
    out = out.withColumn("_all", F.transform("_p", confirmed))
    # a whole paragraph without a standing family says nothing that its sentences don't
    out = out.withColumn("matches", F.filter("_all", lambda m: ~F.exists("_all", lambda o: inside(m, o))))
    out = out.withColumn("_stand", F.filter("matches", stands))
    # a line alone may be surer than the longer part around it
    best = F.array_min(F.transform(F.filter("_all", stands), lambda m: F.struct((-m["probability"]).alias("p"), m["family"].alias("family"))))
    out = out.withColumn("_best", best)
    return out.select(
        "doc_id",
        F.size("matches").cast("long").alias("n_candidates"),
        F.size("_stand").cast("long").alias("n_confirmed"),
        F.array_sort(F.array_distinct(F.transform("_stand", lambda m: m["family"]))).alias("families"),
        F.coalesce(F.col("_best.family"), F.when(F.size("matches") > 0, F.lit(UNKNOWN)).otherwise(F.lit("none"))).alias("licence"),
        F.coalesce(-F.col("_best.p"), F.lit(0.0)).alias("confidence"),
        "matches",
    )
