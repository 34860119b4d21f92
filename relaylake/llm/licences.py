"""Licence recognition by sentences and rules.

A text is split into sentences, each is normalised to lower-case words, known
sentences map to identifiers, and the sequence of identifiers is matched against
an ordered list of rules: longer and more specific rules first, each consuming
the identifiers that it explains.

Plan: a map over the scan. Every known sentence has one of ANCHORS in it, so
texts and sentences without any are skipped by a search; words of an anchor may
stand apart by whatever normalisation makes a blank, so that changes no result
(``known_sentences`` asserts that each has one).

Defined results: a sentence ends at . ! or ? before white space, after the
colon of "conditions:", "restrictions:", "following:", "met:" and "that:", which open a list, or at an empty line; one
that spans lines is looked up whole and, where unknown, line by line; texts without a
known sentence, null and empty ones give no row; very long texts are split whole;
repeated sentences count once for each place; rows with a null id and repeated rows
give their own results; rules are tried in order, so of two that fit the same
sentences the earlier one counts; an empty table gives no rows; input columns may
have any name. The licences known are those of RULES; no other one is found.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SENTENCES = {
    "MIT-grant": ['Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'],
    "MIT-notice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "asis": ['The Software is provided "as is", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement.'],
    "no-liability": ["In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software."],
    "Apache2-head": ['Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'],
    "Apache2-copy": ["You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0"],
    "GPL-redistribute-3+": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "GPL-redistribute-2+": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "GPL-warranty": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."],
    "GPL-received": ["You should have received a copy of the GNU General Public License along with this program."],
    "BSD-grant": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "BSD-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."],
    "BSD-binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."],
    "BSD-endorse": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "Apache2-basis": ['Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'],
    "Apache2-see": ["See the License for the specific language governing permissions and limitations under the License."],
    "Apache2-grant": ["Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form."],
    "LGPL-redistribute-3+": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "LGPL-redistribute-2.1+": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "LGPL-warranty": ["This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."],
    "AGPL-redistribute-3+": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "AGPL-received": ["You should have received a copy of the GNU Affero General Public License along with this program."],
    "GPL-copy": ["Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."],
    "GPL3-body": ["The GNU General Public License is a free, copyleft license for software and other kinds of works."],
    "LGPL3-body": ['This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below.'],
    "AGPL3-body": ["The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software."],
    "ISC-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "ISC-disclaim": ['The software is provided "AS IS" and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness.'],
    "0BSD-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."],
    "Unlicense-free": ["This is free and unencumbered software released into the public domain."],
    "Zlib-grant": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"],
    "Zlib-misrepresented": ["The origin of this software must not be misrepresented; you must not claim that you wrote the original software."],
    "BSL1-grant": ["Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"],
    "BSD-disclaim": ['THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.'],
    "MPL2-head": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v."],
    "EPL2-head": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0", "THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE."],
    "CC0-waived": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "reserved": ["All rights reserved."],
}
#: Identifiers with the names by which "Licensed under ..." speaks of them.
NAMES = {
    "MIT": ["MIT License"], "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0"], "GPL-3.0-only": ["GNU General Public License, version 3", "GNU General Public License version 3", "GNU GPL v3", "GPLv3"],
    "GPL-3.0-or-later": ["GNU General Public License, version 3 or later", "GPLv3+"], "GPL-2.0-only": ["GNU General Public License, version 2", "GNU General Public License version 2", "GNU GPL v2", "GPLv2"],
    "GPL-2.0-or-later": ["GNU General Public License, version 2 or later", "GPLv2+"], "LGPL-2.1-only": ["GNU Lesser General Public License, version 2.1", "LGPLv2.1"], "LGPL-2.1-or-later": ["GNU Lesser General Public License, version 2.1 or later", "LGPLv2.1+"],
    "LGPL-3.0-only": ["GNU Lesser General Public License, version 3", "LGPLv3"], "LGPL-3.0-or-later": ["GNU Lesser General Public License, version 3 or later", "LGPLv3+"], "AGPL-3.0-only": ["GNU Affero General Public License, version 3", "AGPLv3"],
    "AGPL-3.0-or-later": ["GNU Affero General Public License, version 3 or later", "AGPLv3+"], "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License"], "BSD-3-Clause": ["BSD 3-Clause License", "New BSD License", "Modified BSD License"],
    "BSD-4-Clause": ["BSD 4-Clause License"], "0BSD": ["BSD Zero Clause License"], "ISC": ["ISC License"], "MPL-1.1": ["Mozilla Public License 1.1"], "MPL-2.0": ["Mozilla Public License 2.0", "Mozilla Public License, version 2.0"],
    "EPL-1.0": ["Eclipse Public License 1.0"], "EPL-2.0": ["Eclipse Public License 2.0"], "CDDL-1.0": ["Common Development and Distribution License 1.0"], "EUPL-1.2": ["European Union Public Licence 1.2", "EUPL 1.2"],
    "Unlicense": ["Unlicense"], "Zlib": ["zlib License"], "BSL-1.0": ["Boost Software License 1.0", "Boost Software License, Version 1.0"], "Artistic-2.0": ["Artistic License 2.0"], "PostgreSQL": ["PostgreSQL License"], "Python-2.0": ["Python Software Foundation License"],
    "WTFPL": ["WTFPL"], "MS-PL": ["Microsoft Public License"], "MS-RL": ["Microsoft Reciprocal License"], "OFL-1.1": ["SIL Open Font License, Version 1.1", "SIL Open Font License 1.1"], "NCSA": ["University of Illinois/NCSA Open Source License"], "W3C": ["W3C Software Notice and License"],
    "CC0-1.0": ["CC0 1.0", "CC0"], "CC-BY-3.0": ["CC BY 3.0", "Creative Commons Attribution 3.0 License"], "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"], "CC-BY-SA-3.0": ["CC BY-SA 3.0", "Creative Commons Attribution-ShareAlike 3.0 License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"], "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"], "CC-BY-NC-SA-4.0": ["CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"],
    "CC-BY-NC-ND-4.0": ["CC BY-NC-ND 4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"],
}


def _references(spdx: str, names: list[str]) -> list[str]:
    """The sentences that refer to a licence by its identifier or a name of it."""
    said = [f"SPDX-License-Identifier: {spdx}", f"License: {spdx}"]
    for name in names:
        said += [f"{begin} {the}{name}." for begin in ("Licensed under", "Released under", "This work is licensed under", "This project is licensed under", "Distributed under") for the in ("the ", "")]
    return said


SENTENCES |= {f"ref:{spdx}": _references(spdx, names) for spdx, names in NAMES.items()}
SENTENCES["ref:CC-BY-4.0"] += ["This work is licensed under a Creative Commons Attribution 4.0 International License."]
SENTENCES["ref:CC-BY-SA-4.0"] += ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."]
SENTENCES["ref:CC-BY-NC-4.0"] += ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."]
RULES = [
    ("MIT", ["MIT-grant", "MIT-notice", "asis", "no-liability"]),
    ("MIT", ["MIT-grant", "MIT-notice", "asis"]),
    ("GPL-3.0-or-later", ["GPL-redistribute-3+", "GPL-warranty", "GPL-received"]),
    ("GPL-2.0-or-later", ["GPL-redistribute-2+", "GPL-warranty", "GPL-received"]),
    ("AGPL-3.0-or-later", ["AGPL-redistribute-3+", "GPL-warranty", "AGPL-received"]),
    ("LGPL-2.1-or-later", ["LGPL-redistribute-2.1+", "LGPL-warranty"]),
    ("LGPL-3.0-or-later", ["LGPL-redistribute-3+", "LGPL-warranty"]),
    ("BSD-3-Clause", ["BSD-grant", "BSD-source", "BSD-binary", "BSD-endorse", "BSD-disclaim"]),
    ("BSD-3-Clause", ["BSD-grant", "BSD-source", "BSD-binary", "BSD-endorse"]),
    ("BSD-2-Clause", ["BSD-grant", "BSD-source", "BSD-binary", "BSD-disclaim"]),
    ("BSD-2-Clause", ["BSD-grant", "BSD-source", "BSD-binary"]),
    ("Apache-2.0", ["Apache2-head", "Apache2-copy", "Apache2-basis", "Apache2-see"]),
    ("Apache-2.0", ["Apache2-head", "Apache2-copy"]),
    ("ISC", ["ISC-grant", "ISC-disclaim"]),
    ("0BSD", ["0BSD-grant", "ISC-disclaim"]),
    ("MIT", ["MIT-grant", "MIT-notice"]),
    ("BSL-1.0", ["BSL1-grant"]),
    ("ISC", ["ISC-grant"]),
    ("0BSD", ["0BSD-grant"]),
    ("Zlib", ["Zlib-grant", "Zlib-misrepresented"]),
    ("Zlib", ["Zlib-grant"]),
    ("Unlicense", ["Unlicense-free"]),
    ("AGPL-3.0-only", ["GPL-copy", "AGPL3-body"]),
    ("GPL-3.0-only", ["GPL-copy", "GPL3-body"]),
    ("LGPL-3.0-only", ["GPL-copy", "LGPL3-body"]),
    ("Apache-2.0", ["Apache2-grant"]),
    ("AGPL-3.0-or-later", ["AGPL-redistribute-3+"]),
    ("LGPL-3.0-or-later", ["LGPL-redistribute-3+"]),
    ("LGPL-2.1-or-later", ["LGPL-redistribute-2.1+"]),
    ("GPL-3.0-or-later", ["GPL-redistribute-3+"]),
    ("GPL-2.0-or-later", ["GPL-redistribute-2+"]),
    ("Apache-2.0", ["Apache2-head"]),
    ("MPL-2.0", ["MPL2-head"]),
    ("EPL-2.0", ["EPL2-head"]),
    ("CC0-1.0", ["CC0-waived"]),
    *[(spdx, [f"ref:{spdx}"]) for spdx in NAMES],
    ("all-rights-reserved", ["reserved"]),
]
#: Lower-case substrings, one of which every known sentence contains.
ANCHORS = ["licens", "licence", "copyright", "permission", "warrant", "liab", "redistribut", "general public", "rights reserved", "released under", "distributed under", "unencumbered", "origin of this software"]


def split_python(text: str) -> list[str]:
    """Sentences of a text, by the rules above; the SQL and Spark forms must agree with it."""
    return re.sub(r"([.!?]|(?i:conditions|restrictions|following|met|that):)\s+", r"\1\n\n", text).split("\n\n")


def normal_python(sentence: str) -> str:
    return re.sub(r"[^a-z0-9]+", " ", sentence.lower()).strip()


def known_sentences() -> dict[str, str]:
    """Normalised sentence -> identifier. A text of several sentences maps by its last piece."""
    known: dict[str, str] = {}
    for name, texts in SENTENCES.items():
        for text in texts:
            piece = normal_python(split_python(text)[-1] if len(split_python(text)[-1].split()) > 2 else text)
            assert any(a in piece for a in ANCHORS), piece
            known[piece] = name
    return known


def _normal(s: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " "))


def recognise(df: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, sentence_ids, licences) of each text that has a known sentence.

    ``sentence_ids`` is the sequence as <a><b>...; ``licences`` lists the rules
    met, in rule order and without repetition, or is empty.
    """
    text = F.col(f"`{text_column}`")
    known = F.create_map(*[F.lit(x) for pair in known_sentences().items() for x in pair])
    anchors = "|".join(a.replace(" ", "[^a-z0-9]+") for a in ANCHORS)
    has = lambda s: F.lower(s).rlike(anchors)
    look = lambda s: F.try_element_at(known, _normal(s))
    rows = df.where(has(text)).select(F.col(f"`{id_column}`").alias("doc_id"), F.filter(F.split(F.regexp_replace(text, r"([.!?]|(?i:conditions|restrictions|following|met|that):)\s+", "$1\n\n"), "\n\n"), has).alias("ss"))
    by_line = lambda s: F.filter(F.transform(F.filter(F.split(s, "\n"), has), look), lambda x: x.isNotNull())
    ids = F.flatten(F.transform("ss", lambda s: F.when(look(s).isNotNull(), F.array(look(s))).otherwise(by_line(s))))
    rows = rows.select("doc_id", F.array_join(F.transform(ids, lambda x: F.concat(F.lit("<"), x, F.lit(">"))), "").alias("sentence_ids")).where(F.col("sentence_ids") != "")
    left, met = F.col("sentence_ids"), []
    for name, sequence in RULES:
        pattern = "".join(f"<{x}>" for x in sequence)
        met.append(F.when(left.contains(pattern), name))
        left = F.replace(left, F.lit(pattern), F.lit("#"))
    return rows.select("doc_id", "sentence_ids", F.array_join(F.array_distinct(F.filter(F.array(*met), lambda x: x.isNotNull())), ",").alias("licences"))


def oracle(documents: str = "documents") -> str:
    """The same as DuckDB SQL."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    known = "MAP {" + ", ".join(f"{q(k)}: {q(v)}" for k, v in known_sentences().items()) + "}"
    norm = lambda s: f"trim(regexp_replace(lower({s}), '[^a-z0-9]+', ' ', 'g'))"
    left, met = "sentence_ids", []
    for name, sequence in RULES:
        pattern = q("".join(f"<{x}>" for x in sequence))
        met.append(f"CASE WHEN contains({left}, {pattern}) THEN {q(name)} END")
        left = f"replace({left}, {pattern}, '#')"
    firsts = ", ".join(met)
    return f"""
WITH s AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '([.!?]|(?i:conditions|restrictions|following|met|that):)\\s+', '\\1' || chr(10) || chr(10), 'g'), chr(10) || chr(10))) AS s,
             generate_subscripts(string_split(regexp_replace(text, '([.!?]|(?i:conditions|restrictions|following|met|that):)\\s+', '\\1' || chr(10) || chr(10), 'g'), chr(10) || chr(10)), 1) AS i
           FROM {documents} WHERE text IS NOT NULL),
m AS (SELECT doc_id, i, s, ({known})[{norm('s')}] AS k FROM s),
l AS (SELECT doc_id, i, 0 AS j, k FROM m WHERE k IS NOT NULL
      UNION ALL SELECT doc_id, i, j, ({known})[{norm('line')}] FROM (
        SELECT doc_id, i, unnest(string_split(s, chr(10))) AS line, generate_subscripts(string_split(s, chr(10)), 1) AS j FROM m WHERE k IS NULL)),
d AS (SELECT doc_id, string_agg('<' || k || '>', '' ORDER BY i, j) AS sentence_ids FROM l WHERE k IS NOT NULL GROUP BY doc_id),
r AS (SELECT doc_id, sentence_ids, list_filter([{firsts}], lambda x: x IS NOT NULL) AS ls FROM d)
SELECT doc_id, sentence_ids, coalesce(array_to_string(list_filter(ls, lambda x, i: list_position(ls, x) = i), ','), '') AS licences FROM r"""
