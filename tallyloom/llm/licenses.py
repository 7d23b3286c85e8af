"""License scan by canonical digests.

A whole text is lower-cased, loses its copyright lines and its punctuation, has equivalent spellings unified, and its SHA-256 is
looked up among those of known licences in the same form. Matching is of entire texts: a licence quoted inside another text is no match.
Besides, each line of a text is looked up, whole, among the usual notices ("Released under the MIT License.").

Null and empty texts, and texts of copyright lines alone, are empty in that form and match nothing; an empty table gives an empty one. Repeated rows
and null ids come out as they came in, as often as they came in. The table of licences is part of this module, so it is broadcast, and notices are
a literal map. Only DataFrame functions are used.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COPYRIGHT = r"(^|\n)[^\p{L}\p{N}\n]*(?:copyright|c copyright|all rights reserved|©)[^\n]*"
COPYRIGHT_C = r"(^|\n)[ \t]*\(c\)[^\n]*"
OTHER = r"[^\p{L}\p{N}]+"
SAME = (("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("sub license", "sublicense"), ("organisation", "organization"), ("authorised", "authorized"), ("favour", "favor"), ("per cent", "percent"), ("copyright owner", "copyright holder"), ("copyright owners", "copyright holders"), ("merchantibility", "merchantability"), ("non infringement", "noninfringement"), ("acknowledgement", "acknowledgment"), ("wilful", "willful"))

_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
_BSD_TAIL = "\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_TAIL = "\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n" + _AS_IS + " IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_ZLIB = "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution."

_BOOST = "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:\n\nThe copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_UNLICENSE = "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."

#: License id -> texts that count as it, whole.
LICENSES: dict[str, tuple[str, ...]] = {
    "MIT": (_MIT, "MIT License\n\n" + _MIT, "The MIT License (MIT)\n\n" + _MIT),
    "ISC": (_ISC.replace("and/or", "and") + ", provided that the above copyright notice and this permission notice appear in all copies." + _ISC_TAIL, _ISC + ", provided that the above copyright notice and this permission notice appear in all copies." + _ISC_TAIL, "ISC License\n\n" + _ISC + ", provided that the above copyright notice and this permission notice appear in all copies." + _ISC_TAIL),
    "0BSD": (_ISC + "." + _ISC_TAIL, "BSD Zero Clause License\n\n" + _ISC + "." + _ISC_TAIL),
    "BSD-2-Clause": (_BSD_HEAD + _BSD_TAIL, "BSD 2-Clause License\n\n" + _BSD_HEAD + _BSD_TAIL),
    "BSD-3-Clause": tuple(title + _BSD_HEAD + "\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n" + _BSD_TAIL for title in ("", "BSD 3-Clause License\n\n")),
    "Zlib": (_ZLIB, "zlib License\n\n" + _ZLIB),
    "BSL-1.0": tuple(title + _BOOST for title in ("", "Boost Software License - Version 1.0 - August 17th, 2003\n\n")),
    "Unlicense": (_UNLICENSE, _UNLICENSE + "\n\nFor more information, please refer to <https://unlicense.org>", _UNLICENSE + "\n\nFor more information, please refer to <http://unlicense.org/>"),
}

# SHA-256 of the canonical forms of long licences' published texts, and of their terms alone (without what follows "END OF TERMS AND CONDITIONS").
DIGESTS: dict[str, tuple[str, ...]] = {
    "Apache-2.0": ("0d5838e6f6e5a374e58d608af5c01bc6a67cf18552dd7b346e5aef652b808ee9", "0933e9fdf25f8a4aced10e10246650350123e13b939182f69b5ec6730ce2d793", "a657010cc8660623635462386107381af70d2c7ec43ab36e27484c72cbb3b28f",),
    "Artistic-1.0-Perl": ("93aa47d57763801ed6e6a6591d4d4049a2c46794df90838023ceade56b569da0",),
    "CC0-1.0": ("cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e",),
    "GFDL-1.2": ("f06741c6c5feec30d99f80228f0d9ea6b884eae0e790ab18a0f4257184befa86",),
    "GFDL-1.3": ("80229e90e6f40a551a447f33ef48bd361a8e3166d53f29a2d1537245e2064feb",),
    "GPL-1.0": ("9e12a40a9b22c45d116f19e1746b08ea0b853519de3e03ceb780f2a36d5f388c", "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc", "89f75ffda938e788be38679f9f83e317c2a03398fccf03ee60505d44d1bf9f70",),
    "GPL-2.0": ("b866f5427b78991db8012466b32f51c907f5e974fde5129a47372d0d0552e3a1", "e4d14510e41435c3eb12c255b72546a3cb9943f06f209c72bc30a19095b08999", "a1e7ba14d8d85807f384435b77f91e925decc43da128311c991c4f2337e44017",),
    "GPL-3.0": ("5272fb2d9117cba4ebb1b4a6612e61ab05ddddeff56bd30c3ac3798e23821b30", "f7bb29d9a31c3a1a68ccff0d8d9053350dc0b10b52b62d46d0f2e36a41e32975", "f37d587507fc579524cb06d1130d5899891a978ee008cfc033b3b4d95da28bee",),
    "LGPL-2.0": ("b4114daa3dfa52e27e78b2c4e17acd58bf4381e812762f4ded0bcb8eabd1092c", "ff773d8d898dfc51ae2dbf3baa20700673e8ceb153b13d26c525af34a59adf0c", "e0de5033b5ad2a24c0a1a8b04f09e33038ffa62d2bef7178de2a3c6f5d56f499",),
    "LGPL-2.1": ("294fb9ec58649c7eb0cf90fc2900ac1b28b82fb6da9d40d7599d6b7d399d4d2e", "963f79d48038eed98d8341c84d8d3b765e99508a738d00654c0112f70a7c370c", "9bf9c99aeafbdbccd7456a00d574699e3deb41868375496cacbf170be719bebd",),
    "LGPL-3.0": ("aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",),
    "MPL-1.1": ("1cfb6cca26abe2169c9c61164807107b2d4a0b64955a2cf2de46fad3483acda1",),
    "MPL-2.0": ("95f6a0d094cf3da6a140310541c7b576789031b600469b70877b34f97918e4c9",),
}

#: License id -> lines that are a notice of it.
NOTICES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\");"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC0-1.0": ("Released under CC0 1.0.",),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.",),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.",),
    "AGPL-3.0": ("This work is licensed under the GNU Affero General Public License, version 3.",),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.",),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "MIT": ("Released under the MIT License.", "Licensed under the MIT License."),
}


def canonical(text: Column) -> Column:
    s = F.lower(F.coalesce(text.cast("string"), F.lit("")))
    s = F.regexp_replace(F.regexp_replace(s, COPYRIGHT, "$1"), COPYRIGHT_C, "$1")
    # Two spaces between words, so that of neighbours that have other spellings each is found.
    s = F.concat(F.lit(" "), F.trim(F.regexp_replace(s, OTHER, "  ")), F.lit(" "))
    for a, b in SAME:
        s = F.replace(s, F.lit(_spaced(a)), F.lit(_spaced(b)))
    return F.trim(F.replace(s, F.lit("  "), F.lit(" ")))


def _spaced(spelling: str) -> str:
    return f" {spelling.replace(' ', '  ')} "


def canonical_text(text: str) -> str:
    """The same in Python, for the texts above (ASCII)."""
    s = text.lower()
    for pattern in (COPYRIGHT, COPYRIGHT_C):
        s = re.sub(pattern.replace(r"\p{L}\p{N}", "a-z0-9"), r"\1", s)
    s = f" {re.sub('[^a-z0-9]+', '  ', s).strip()} "
    for a, b in SAME:
        s = s.replace(_spaced(a), _spaced(b))
    return s.strip().replace("  ", " ")


def _digest(text: str) -> str:
    return hashlib.sha256(canonical_text(text).encode()).hexdigest()


def digests() -> list[tuple[str, str]]:
    """(digest, license id) of LICENSES."""
    return sorted({_digest(x): k for k, texts in LICENSES.items() for x in texts}.items())


def known_digests() -> list[tuple[str, str]]:
    """(digest, license id) of all that a whole text is looked up among; a notice alone is a text, too."""
    return sorted({*digests(), *notice_digests(), *((x, k) for k, xs in DIGESTS.items() for x in xs)})


def notice_digests() -> list[tuple[str, str]]:
    """(digest, license id) of the notices."""
    return sorted((_digest(x), k) for k, texts in NOTICES.items() for x in texts)


#: A line without this in lower case is no notice, and no longer one than LONGEST is.
WORD, LONGEST = "licen", 200
_ALSO = "cc0"


def notices(text: Column) -> Column:
    """The licences of which a line of the text is a notice, sorted, joined by commas; null if there is none."""
    said = F.create_map(*(F.lit(x) for pair in notice_digests() for x in pair))
    low = lambda x: F.lower(x)
    near = F.filter(F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1), lambda x: (F.length(x) <= LONGEST) & (F.contains(low(x), F.lit(WORD)) | F.contains(low(x), F.lit(_ALSO))))
    found = F.array_sort(F.array_distinct(F.filter(F.transform(near, lambda x: F.try_element_at(said, F.sha2(canonical(x), 256))), lambda x: x.isNotNull())))
    return F.when(F.size(found) > 0, F.concat_ws(",", found))


def scan(docs: DataFrame, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """doc_id, digest (of the canonical text; null if that is empty), license (null if the whole text is none) and notices (null if no line is one)."""
    spark: SparkSession = docs.sparkSession
    table = spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in known or known_digests()) + " AS t(digest, license)")
    form = docs.select("doc_id", canonical(F.col("text")).alias("form"), notices(F.col("text")).alias("notices"))
    form = form.select("doc_id", F.when(F.col("form") != "", F.sha2("form", 256)).alias("digest"), "notices")
    return form.join(F.broadcast(table), "digest", "left").select("doc_id", "digest", "license", "notices")
