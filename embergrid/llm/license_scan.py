"""Operator 4: licence scans by canonical digests, with DataFrame functions alone.

A text is brought to a canonical form (lower case, no copyright lines, punctuation and white space as single spaces, one
spelling for equivalent words) and its SHA-256 is looked up among the digests of known licence texts by a hash join. The
same is done for every line as a whole, against the digests of known one-line notices.

Defined cases: null and empty texts, and texts of copyright lines alone, have an empty canonical form and match nothing;
texts are read whole, however long; repeated rows give repeated results; no two licences share a canonical form, so there
are no ties; a carried column gives way to an output of the same name; an empty table has no rows.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spellings held equal, the first becomes the second.
EQUIVALENT = (
    ("acknowledgement", "acknowledgment"), ("analyse", "analyze"), ("artefact", "artifact"), ("authorisation", "authorization"),
    ("authorised", "authorized"), ("behaviour", "behavior"), ("cancelled", "canceled"), ("colour", "color"), ("favour", "favor"),
    ("fulfil ", "fulfill "), ("initialise", "initialize"), ("judgement", "judgment"), ("labelled", "labeled"), ("licence", "license"),
    ("merchantibility", "merchantability"), ("noncommercial", "non commercial"), ("organisation", "organization"), ("owner", "holder"),
    ("per cent", "percent"), ("recognise", "recognize"), ("sub license", "sublicense"), ("utilisation", "utilization"), ("whilst", "while"),
    ("wilful", "willful"),
)

#: Licence texts in public use, by SPDX identifier.
TEXTS = {
    "MIT": """MIT License
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """ISC License
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """BSD 2-Clause License
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <https://unlicense.org>""",
    "0BSD": """Zero-Clause BSD
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Zlib": """zlib License
This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
}

_NAME_CLAUSE = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY"""
TEXTS["BSD-3-Clause"] = TEXTS["BSD-2-Clause"].replace("BSD 2-Clause", "BSD 3-Clause").replace("THIS SOFTWARE IS PROVIDED BY", _NAME_CLAUSE)
#: Licences whose notice above is no title line.
UNTITLED = ("Apache-2.0", "Unlicense")

#: Digests of the canonical form of longer licence texts, as distributions ship them.
DIGESTS = {
    "Apache-2.0": "82907cd782be18972be6db74ff65324dfdbe68ab7fcc4e694cd306d584ab0e27",
    "Artistic-1.0-Perl": "c9bcba9e70d36ab628a0944e717aa88f7b65f5755a9f3061c584801892429806",
    "CC0-1.0": "de4b88a2c819a4661af54f735069ed878216da8b4992b919b84afa18cfc0e54c",
    "GFDL-1.2": "890d36e662cb09f33113b55d7d1c753ddc4b0ead994791dfdbdaf4349bb51e36",
    "GFDL-1.3": "ade5f7440f9cc494ee9b2d9d76ef9d5e7528b55ddcc78de4bc94bea8a66d4e50",
    "GPL-1.0": "9caf042595280548f0149ac88169a7f2e04f35b2a642cf00b991f00d48bfa4ce",
    "GPL-2.0": "331b500eb3c5ee796906547305df82fff4a35b3aa03c1d3ea84d32078292b2e6",
    "GPL-3.0": "6d90388911aaf82045e4be1f8d0ad5292a38dc9e44885b79982b60ab392ec6f4",
    "LGPL-2.0": "5b313222545879140519fc4f8ac7558088e9529f29bda08d2b75946987652f50",
    "LGPL-2.1": "6ce9e9dc5005db9536b303ace5104e7d79eb77fa76f5ca2e335ea6401497ea1e",
    "LGPL-3.0": "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",
    "MPL-1.1": "327ae687cdcd9daad4bffe7c45689cd08d8489598c556cb30abf5955ea31140e",
    "MPL-2.0": "47a6a26dd655037b8b3d248dc45b3bc3df58bade00030fd466f738a08cc754ef",
}

#: Names by which notices call a licence, by SPDX identifier.
NAMES = {
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0"),
    "MIT": ("MIT License", "MIT"),
    "BSD-2-Clause": ("BSD 2-Clause License", "BSD-2-Clause"),
    "BSD-3-Clause": ("BSD 3-Clause License", "BSD-3-Clause"),
    "ISC": ("ISC License", "ISC"),
    "GPL-2.0": ("GNU General Public License, version 2", "GPL-2.0", "GPLv2"),
    "GPL-3.0": ("GNU General Public License, version 3", "GPL-3.0", "GPLv3"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "LGPL-3.0"),
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "AGPL-3.0"),
    "MPL-2.0": ("Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL-2.0"),
    "CC0-1.0": ("CC0 1.0", "CC0-1.0"),
    "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0"),
    "Unlicense": ("Unlicense", "The Unlicense"),
}
OPENINGS = (
    "Released under {}", "Licensed under {}", "Distributed under {}", "Available under {}", "This work is licensed under {}",
    "This project is licensed under {}", "This software is licensed under {}", "This file is licensed under {}",
    "SPDX-License-Identifier: {}",
)

#: Lines of a notice of copyright; a wrapped sentence may begin a line with the same word, and a clause with "(c)".
_NOTICE = (
    r"(copyright(?! (holder|owner|notice|law|licen|interest|permission|disclaimer|statement|treat|doctrine|the software|and |or |on |in |is |are |if |to |as |that |by this ))"
    r"|\(c\)(?! (you|if|a|the|in|to|any|each|accompany|under) )|©|all rights reserved)"
)
_COPYRIGHT = r"^[^\p{L}\p{N}]*" + _NOTICE + ".*"


def canonical_line(line: Column) -> Column:
    """Canonical form of one line; an empty string for a copyright line. Spelling pairs act on whole, spaced text."""
    low = F.lower(line)
    out = F.when(low.rlike(_COPYRIGHT), F.lit("")).otherwise(F.regexp_replace(low, r"[^\p{L}\p{N}]+", " "))
    return F.trim(out)


def respell(text: Column) -> Column:
    out = text
    for old, new in EQUIVALENT:
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.trim(out)


def canonical(text: str) -> str:
    """The same in Python, for the few known texts (never for documents)."""
    lines = []
    for line in text.split("\n"):
        low = line.lower()
        if not re.match(r"^[\W_]*" + _NOTICE, low):
            lines.append(re.sub(r"[\W_]+", " ", low).strip(" "))
    out = " ".join(x for x in lines if x)
    for old, new in EQUIVALENT:
        out = out.replace(old, new)
    return out.strip(" ")


def digest(text: str) -> str:
    return hashlib.sha256(canonical(text).encode()).hexdigest()


def known_texts() -> list[tuple[str, str]]:
    """(digest, licence) of whole texts, each with and without its title line; a fixed number of rows."""
    rows = {}
    for name, text in TEXTS.items():
        rows[digest(text)] = name
        if name not in UNTITLED:
            rows[digest(text.split("\n", 1)[1])] = name
    rows |= {d: name for name, d in DIGESTS.items()} | known_notices()
    return sorted(rows.items())


def known_notices() -> dict[str, str]:
    rows = {}
    for name, called in NAMES.items():
        for form in OPENINGS:
            for x in called:
                for article in ("", "the "):
                    rows[digest(form.format(article + x))] = name
    return rows


def openings_pattern() -> str:
    """A pattern for canonical lines, before respelling, that begin as a known notice does, in any of the equal spellings."""
    heads = {canonical(form.format("")) for form in OPENINGS}
    for old, new in EQUIVALENT:
        heads = {h.replace(new, f"(?:{old}|{new})") for h in heads}
    return "^(?:" + "|".join(sorted(heads)) + ") "


def license_scan(df: DataFrame, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Append text_digest (null for an empty form), license_id of the whole text, and notices (sorted licences named by
    whole lines) with n_notices.

    One narrow stage: the digests of known texts are a constant of some hundred rows, so the join broadcasts them, and
    the notices are a map literal of the same size. No shuffle, no Python.
    """
    spark: SparkSession = df.sparkSession
    outs = ("text_digest", "license_id", "notices", "n_notices")
    carried = [F.col(f"`{c}`") for c in dict.fromkeys(carry) if c not in outs]
    known = F.broadcast(spark.createDataFrame(known_texts(), "__digest string, license_id string"))
    notices = known_notices()
    lookup = F.create_map(*[F.lit(x) for pair in sorted(notices.items()) for x in pair])
    widest = max(len(canonical(o.format("the " + x))) for o in OPENINGS for called in NAMES.values() for x in called)
    begins = openings_pattern()
    lines = F.filter(F.transform(F.split(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), "\n"), canonical_line), lambda x: x != "")
    work = df.select(*carried, lines.alias("__lines"))
    whole = respell(F.concat_ws(" ", "__lines"))
    short = F.filter("__lines", lambda x: (F.length(x) <= widest + 16) & x.rlike(begins))
    named = F.transform(short, lambda x: F.element_at(lookup, F.sha2(respell(x), 256)))
    work = work.select(
        *carried,
        F.when(F.size("__lines") > 0, F.sha2(whole, 256)).alias("text_digest"),
        F.array_sort(F.array_distinct(F.filter(named, lambda x: x.isNotNull()))).alias("notices"),
    )
    joined = work.join(known, F.col("text_digest") == F.col("__digest"), "left")
    return joined.select(*carried, "text_digest", "license_id", "notices", F.size("notices").cast("long").alias("n_notices"))
