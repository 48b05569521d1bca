"""Licence scan by canonical digest lookup, in DataFrame functions only.

A text and each of its lines are brought to a canonical form (lower case, no
copyright lines, one spelling of equivalent words, no punctuation, single
spaces) and hashed.  Entire texts are hash-joined with the digests of known
licence texts; lines are looked up in the same table as a literal map, inside
their row.  The known texts are a constant of this module, so the joined side is
broadcast, and no row of the documents moves: the plan has no shuffle, and every
row has its own result whatever its key is.

A licence text keeps some word such as "licen" or "permission" in any form that
can match, so lines without any of these are not normalised at all.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

#: Spellings that count as equal, after lower-casing and before punctuation goes.
SPELLINGS = (
    ("licence", "license"), ("licencing", "licensing"), ("organis", "organiz"), ("favour", "favor"), ("behaviour", "behavior"), ("honour", "honor"),
    ("colour", "color"), ("recognis", "recogniz"), ("authoris", "authoriz"), ("sub[- ]licens", "sublicens"), ("non[- ]commercial", "noncommercial"), ("per cent", "percent"),
    ("copyright owner", "copyright holder"), ("redistribution's", "redistributions"), ("initialis", "initializ"), ("analys(e|ing)", "analyz$1"), ("whilst", "while"), ("wilful", "willful"), ("programme", "program"),
    ("https:", "http:"), ("\\(r\\)|®|™", ""), ("&", " and "),
)

#: A copyright line: "(c)" or "©", or "copyright" before a year or placeholder;
#: and the sentence that goes with it.
COPYRIGHT = r"^[^\p{L}\n]*((copyright[ \t]*)?(\(c\)|©)|copyright[ \t]+[\d\[<{]|all rights reserved)[^\n]*$"

#: Every known canonical text has one of these; checked by a test.
ANCHORS = "licen|permission|redistribution|domain|warranty"

_NO_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"""
_MIT_NOTICE = ", subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n"

_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

"""
_BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
"""
_WTFPL = """DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE
Version 2, December 2004

Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.

DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE
TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION

0. You just DO WHAT THE FUCK YOU WANT TO.
"""
_POSTGRES = """Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies.

IN NO EVENT SHALL THE UNIVERSITY OF CALIFORNIA BE LIABLE TO ANY PARTY FOR DIRECT, INDIRECT, SPECIAL, INCIDENTAL, OR CONSEQUENTIAL DAMAGES, INCLUDING LOST PROFITS, ARISING OUT OF THE USE OF THIS SOFTWARE AND ITS DOCUMENTATION, EVEN IF THE UNIVERSITY OF CALIFORNIA HAS BEEN ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.

THE UNIVERSITY OF CALIFORNIA SPECIFICALLY DISCLAIMS ANY WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE. THE SOFTWARE PROVIDED HEREUNDER IS ON AN "AS IS" BASIS, AND THE UNIVERSITY OF CALIFORNIA HAS NO OBLIGATIONS TO PROVIDE MAINTENANCE, SUPPORT, UPDATES, ENHANCEMENTS, OR MODIFICATIONS.
"""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.
"""

#: Known texts: full licences, and the notices by which a text states one.
KNOWN: tuple[tuple[str, str], ...] = (
    ("MIT", f"{_MIT}{_MIT_NOTICE}{_NO_WARRANTY}"),
    ("MIT", f"MIT License\n{_MIT}{_MIT_NOTICE}{_NO_WARRANTY}"),
    ("MIT", f"The MIT License (MIT)\n{_MIT}{_MIT_NOTICE}{_NO_WARRANTY}"),
    ("MIT-0", f"MIT No Attribution\n{_MIT}.\n{_NO_WARRANTY}"),
    ("MIT-0", f"{_MIT}.\n{_NO_WARRANTY}"),
    ("ISC", f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n{_ISC_WARRANTY}"),
    ("ISC", f"ISC License\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n{_ISC_WARRANTY}"),
    ("ISC", f"The ISC License\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n{_ISC_WARRANTY}"),
    ("0BSD", f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n{_ISC_WARRANTY}"),
    ("Unlicense", f"{_UNLICENSE}{_NO_WARRANTY.replace("AUTHORS OR COPYRIGHT HOLDERS", "AUTHORS")}\nFor more information, please refer to <https://unlicense.org>"),
    ("Unlicense", f"{_UNLICENSE}{_NO_WARRANTY.replace("AUTHORS OR COPYRIGHT HOLDERS", "AUTHORS")}\nFor more information, please refer to <https://unlicense.org/>"),
    ("Unlicense", f"{_UNLICENSE}{_NO_WARRANTY.replace("AUTHORS OR COPYRIGHT HOLDERS", "AUTHORS")}\nFor more information, please refer to <http://unlicense.org/>"),
    ("BSL-1.0", f"Boost Software License - Version 1.0 - August 17th, 2003\n\n{_BOOST}"),
    ("BSL-1.0", _BOOST),
    ("WTFPL", _WTFPL),
    ("PostgreSQL", _POSTGRES),
    ("Zlib", _ZLIB),
    *((name, head + re.sub(r"(?m)^\d\. ", "", text)) for name, title, text in (("BSD-2-Clause", "BSD 2-Clause License", _BSD_HEAD + _BSD_TAIL), ("BSD-3-Clause", "BSD 3-Clause License", _BSD_HEAD + _BSD_THIRD + _BSD_TAIL)) for head in ("", f"{title}\n")),
    ("BSD-1-Clause", _BSD_HEAD.split("2. ")[0] + _BSD_TAIL),
    ("BSD-2-Clause", f"BSD 2-Clause License\n{_BSD_HEAD}{_BSD_TAIL}"),
    ("BSD-3-Clause", f"BSD 3-Clause License\n{_BSD_HEAD}{_BSD_THIRD}{_BSD_TAIL}"),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_THIRD + _BSD_TAIL),
    ("WTFPL", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\nTERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION\n0. You just DO WHAT THE FUCK YOU WANT TO."),
    ("Unlicense-notice", "This is free and unencumbered software released into the public domain."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("CC0-1.0", "This work is released into the public domain under CC0 1.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
)

#: Canonical digests of licences' whole texts, in the editions that Debian's
#: common-licenses and widely used packages have.
LONG: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "0b8c1a9e0ec99ab3b27e123e667fe4843df4dd7e6c667ccdc634dd6878c5dd6c"),
    ("Apache-2.0", "67e6c9864a42fc797b7f0244a9e5402dbe5d51fd1cbfdbca4f454f8892ab077d"),
    ("GPL-2.0", "1621e400aa6be39582d73898054280049e17414147ae0bbba9563b426f94577e"),
    ("GPL-2.0", "806702cdd9c33f157bb64cf46d06b43e3ba38f7979a19a563d9535d19c27924e"),
    ("GPL-3.0", "6444fc2614d3d188bc0a64e89e8ce6b840d9ef15929ca3943c91f6af5346f03b"),
    ("LGPL-2.1", "7f56c71494f424a7ce04a66ea6e30a0dafdcec3c782c06dccabf05772c7d8275"),
    ("GCC-exception-3.1", "9bce034e324d85802308158ead50159b25a080055c75973cdd78a4b8eabfa8d4"),
    ("Python-2.0", "8295946602d6bebee344262714363fd035c5c857480438c14f2d11126b59034f"),
    ("Python-2.0", "967d2e5a6fb0ce1c1d4bf18d1f754988ae765021c24c09300c926217df9022d7"),
    ("Python-2.0", "40b9af19d3437c4c2f45f06eb67193a4aaca7561d9b16269c66b0b33f8330e2e"),
    ("Zlib", "6087666ecef05cb7086906a468d339490c705f20cff5af1280c59887859b2339"),
    ("Zlib", "99618428d879198d4ae824db7ad07a9d0f9214f15429de52839cbe667713f21a"),
    ("MIT", "a2edba2708402cc1fa3e9fbe9f62edffd8cbd25d00bd7575f20a6e04a1023d5f"),
    ("HPND-sell-variant", "a0f5f1f2c33f763fef6dc430fe13839eeca010c8a225aa6e4f062d1264a3892a"),
    ("0BSD", "25a274d52b3014d9bd64e0f3362fd279ac1655f163d5c518f6b9f6c43354802c"),
    ("Apache-2.0", "4580e5390400d27df89edd0617548ac0e66eaa029f6e07cf98aac9cd100b3a37"),
    ("GPL-1.0", "98db0b473e0a45a62b04a39b6b864b4e079a58d513e2196f94fe7252fa8574a6"),
    ("GPL-2.0", "e95eb1718f9f373d56cc586a5f7d1bfa11668867f6e85e982d2b6108b97d90a1"),
    ("GPL-3.0", "5e06bcb7b8c914d3ffb433229937b503a624ae6c7bb9ac1cad01e35a324bcb6d"),
    ("LGPL-2.0", "e4deecd0730802431ad09f00ae3793f3703c8e4dba639586545d9f958405614d"),
    ("LGPL-2.1", "d3826e4e563a04a354453ff139a32b19d6c3fe283f518eb566107c54e18cd01f"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "fcb579371133afd771fed87cd5d8c6dc5648746c9945d4adf08ec5c79aba5c61"),
    ("MPL-2.0", "9e79a7d513376f6fa1500e4df4f6276c6e7e61c5c3e28dcdb1acee24033acc56"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "94541e73869af10ab6bd68a29575eede324e54e7d5237e7386d12444f593af60"),
    ("GFDL-1.3", "a92fdbaeafedd9cbeb812ebbded06ee07e3b1427c81cfc333e682109c594d826"),
    ("Artistic-1.0-Perl", "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702"),
)


def canonical(text: Column) -> Column:
    """The canonical form of a text; empty if nothing is left of it."""
    out = F.regexp_replace(F.lower(text), "(?md)" + COPYRIGHT, "")
    for variant, one in SPELLINGS:
        out = F.regexp_replace(out, variant, one)
    return F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}]+", " "))


class LicenseScan:
    """Licences that a text, or one of its lines, is the text of.

    Defined results: a null or empty text has none; a licence found in several
    lines counts once in ``licenses`` and each time in ``n_matches``; of one
    digest under several names the first by name counts.  Results are by row:
    repeated and null keys, also of different texts, do not matter.  Texts and
    lines of any length are read whole.  An empty table gives an empty result.
    """

    def __init__(self, key: str = "doc_id", text: str = "text", known: tuple[tuple[str, str], ...] = KNOWN):
        self.key, self.text, self.known = key, text, known

    def digests(self, spark: SparkSession) -> DataFrame:
        """``(license, digest)`` of the known texts, one row per digest."""
        rows = spark.createDataFrame(list(self.known), "license string, body string")
        found = rows.select("license", F.sha2(canonical(F.col("body")), 256).alias("digest"))
        if self.known is KNOWN:
            found = found.unionByName(spark.createDataFrame(list(LONG), "license string, digest string"))
        return found.groupBy("digest").agg(F.min("license").alias("license"))

    def __call__(self, df: DataFrame) -> DataFrame:
        """``(key, n_matches, licenses, whole_license)`` for every row."""
        # a caller's text may have none of the words; then nothing is left out
        anchored = lambda x: F.lower(x).rlike(ANCHORS) if all(re.search(ANCHORS, body.lower()) for _, body in self.known) else F.lit(True)
        digest = lambda x: F.sha2(canonical(x), 256)
        table = self.digests(df.sparkSession).collect()  # the known texts' digests
        by_digest = F.create_map(*(F.lit(v) for r in table for v in (r.digest, r.license)))
        known = df.sparkSession.createDataFrame(table, "digest string, whole_license string")
        docs = df.select(F.col(self.key).alias("k"), F.col(self.text).alias("t")).withColumn("digest", F.when(anchored(F.col("t")), digest(F.col("t"))))
        joined = docs.join(F.broadcast(known), "digest", "left")
        lines = F.filter(F.split("t", "\n"), anchored)
        # lines count if there is more than one, and if the text has any that can match
        named = F.filter(F.transform(lines, lambda x: by_digest[digest(x)]), lambda x: x.isNotNull())
        of_lines = F.when(F.col("digest").isNotNull() & F.col("t").contains("\n"), named).otherwise(F.array().cast("array<string>"))
        found = joined.select("k", "whole_license", of_lines.alias("lines"))
        whole = F.array_compact(F.array("whole_license"))
        return found.select(
            F.col("k").alias(self.key),
            (F.size("lines") + F.size(whole)).cast("long").alias("n_matches"),
            F.array_join(F.array_sort(F.array_distinct(F.concat("lines", whole))), ",").alias("licenses"),
            "whole_license",
        )


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return LicenseScan()(read(spark, sf_dir, "documents"))


def _sql_canonical(column: str) -> str:
    quote = lambda s: s.replace("'", "''")
    out = f"regexp_replace(lower({column}), '(?m){quote(COPYRIGHT)}', '', 'g')"
    for variant, one in SPELLINGS:
        out = f"regexp_replace({out}, '{quote(variant)}', '{quote(one).replace('$1', chr(92) + '1')}', 'g')"
    return rf"trim(regexp_replace({out}, '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


def oracle() -> str:
    values = ", ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b in KNOWN)
    long = ", ".join(f"('{a}', '{b}')" for a, b in LONG)
    return f"""
WITH known AS (
  SELECT digest, min(license) AS license FROM (
    SELECT sha256({_sql_canonical('body')}) AS digest, license FROM (VALUES {values}) AS v(license, body)
    UNION ALL
    SELECT digest, license FROM (VALUES {long}) AS v(license, digest)
  ) GROUP BY 1
), numbered AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, text FROM documents
), docs AS (
  SELECT r, text FROM numbered WHERE regexp_matches(lower(text), '{ANCHORS}')
), units AS (
  SELECT r, true AS whole, text AS u FROM docs
  UNION ALL
  SELECT r, false, u FROM (SELECT r, unnest(string_split(text, chr(10))) AS u, len(string_split(text, chr(10))) AS n FROM docs)
  WHERE n > 1 AND regexp_matches(lower(u), '{ANCHORS}')
), found AS (
  SELECT r, whole, license FROM (SELECT r, whole, sha256({_sql_canonical('u')}) AS digest FROM units) JOIN known USING (digest)
), per AS (
  SELECT r, count(*) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses, min(license) FILTER (whole) AS whole_license FROM found GROUP BY 1
)
SELECT doc_id, coalesce(n, 0) AS n_matches, coalesce(licenses, '') AS licenses, whole_license
FROM numbered LEFT JOIN per USING (r)
"""
