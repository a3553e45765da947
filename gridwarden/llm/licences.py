"""Licence scan by canonical digests, in built-in functions only.

A text is made canonical: lower case; lines that state a copyright or reserve
rights are dropped; spellings that licence guidelines treat as equal become one;
everything but letters and digits becomes one space.  The SHA-256 of the result is
joined to the digests of known licences.  So a whole text that is a licence is found whatever its
layout, holder or year.  A line that names a licence is a text of its own, a notice, and is looked up in
the same way among notices, which a rule makes from names and phrases (``notices``).

Known licences are a parameter of ``scan``, as texts and as digests.  The defaults are constants of this
module: short licences as texts, long ones as digests of their published texts.  A known table
has some thousand rows at most whatever the documents are, so it is broadcast; documents
are neither shuffled nor collected.

Cases: a null or empty text, or one without a letter or digit, has the digest of the
empty text and no licence; of two known licences with one digest the first by identifier counts; a very long text is one digest; repeated rows get
equal results; extra columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Equal spellings, (pattern, replacement) on lower-case text.
SPELLINGS = [
    ("licence", "license"),
    ("favour", "favor"),
    ("honour", "honor"),
    ("organisation", "organization"),
    ("judgement", "judgment"),
    ("merchantibility", "merchantability"),
    ("non-commercial", "noncommercial"),
    ("sub-license", "sublicense"),
    ("copyright holder", "copyright owner"),
    ("https:", "http:"),
]

_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
    "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE "
    "USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD_START = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
    "materials provided with the distribution.\n"
)
_MIT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the '
    "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
    "permit persons to whom the Software is furnished to do so, subject to the following conditions:\n"
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n"
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
    "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_END = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO '
    "EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN "
    "ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
#: Public licence texts without a title, (identifier, text).
_PLAIN = [
    ("MIT", _MIT),
    ("BSD-2-Clause", _BSD_START + _BSD_END),
    (
        "BSD-3-Clause",
        _BSD_START
        + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
        + _BSD_END,
    ),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n" + _ISC_END),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n" + _ISC_END),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n"
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n"
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product "
        "documentation would be appreciated but is not required.\n"
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n"
        "3. This notice may not be removed or altered from any source distribution.",
    ),
]
#: Title lines that a licence file may begin with.
_TITLES = {
    "MIT": ["MIT License", "The MIT License (MIT)", "The MIT License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License", 'BSD 2-Clause "Simplified" License'],
    "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License'],
    "ISC": ["ISC License", "The ISC License"],
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD"],
    "Zlib": ["zlib License", "The zlib License"],
}


def _listed(text: str) -> list[str]:
    """The text with its list numbered, with bullets, and with letters."""
    return list(dict.fromkeys([text, re.sub(r"(?m)^[0-9]\. ", "* ", text), re.sub(r"(?m)^([0-9])\. ", lambda m: f"({'abc'[int(m[1]) - 1]}) ", text)]))


#: Known texts, (identifier, text): with and without each title, with each kind of list.
TEXTS = [(name, title + text) for name, plain in _PLAIN for text in _listed(plain) for title in ["", *(f"{t}\n" for t in _TITLES[name])]]
#: SHA-256 of the canonical published texts of long licences, whole, and up to the end of their terms.
DIGESTS = [
    ("Apache-2.0", "37599287c15c2f2ec060c3c3b55bdf69e3bc7a8aeeb9cd57e18800088789538a"),
    ("Apache-2.0", "e87dea5078ce2faaea46d3475af18d30a5c0ac0f09425b60b3e0c6569f72f8d2"),
    ("Apache-2.0", "f45538b138cf9aea39fa205de037a0bede8305e68281650e7ab809a8b3ebb2f0"),
    ("Artistic-1.0-Perl", "bc4d0c00d493021b9f3b1041689fa28b4bf980cf2e37601f7cb475a7265e3b93"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "b6270c129be9b0e0172ebf4f39b974d927f155b0569e6689a4fd15068977ecdd"),
    ("GFDL-1.3", "7a546845f0b9175c013adbd275ab046668c2cd62fa85809f866f6d3218d6adcd"),
    ("GPL-1.0", "37f380f152339f34a15db620545eb53f0b5c7d9e6a9542aa09ed0d22f186920f"),
    ("GPL-1.0", "3b5b36de4a3801680b9eb44e80739b3aeb71c4bf6ca623ee5f87b2e2b03d3ed9"),
    ("GPL-1.0", "4575f8cf583cfe5694de121df7d28ae3c2043234ee2357a6bc38c20fc1856cf0"),
    ("GPL-2.0", "611467176757b44c5c63b6b18b9b61a9e3d7bd13d738d6dde1cdce99fb1f12ef"),
    ("GPL-2.0", "a76cc6ce70778ba70e43b9b1838f9e3f88b3fc7c5acbb3b8a9847918003b63e0"),
    ("GPL-2.0", "ae2be2aaa68f5e52ef402874fc8c7c691879b445cb12e49d84f88168cc2d7dd6"),
    ("GPL-3.0", "158302bba42ffffd9ebd468b95aca480c990d662430ac44bb2edba378ebeb545"),
    ("GPL-3.0", "42b67f6c2a10d2b6cb4c48a2c1a454953ad6d664174e0493c9d92e45feb4b408"),
    ("GPL-3.0", "53a654ec022bebac4b8c6908b7a8d7e2b63dd0b041d77833e8af6b3913048c9b"),
    ("LGPL-2.0", "3ea7beb964a4396aa5ad75de90dd58ff01913b237f397517e8563b7acf07d87c"),
    ("LGPL-2.0", "7d5246cc24a9d78fffd01a07fbc2e71edd1e94ad8d403f3180a4cf5fef43d389"),
    ("LGPL-2.0", "bea988245c65edbddad6f43ff12ca2472c232324e916d42648b90eac944d833e"),
    ("LGPL-2.1", "65484d3c9f900f96945bd4e6c5397aaa24f93bdc8f720eae06fbd377c62cfe97"),
    ("LGPL-2.1", "9c2c2afdce244f7835e438f43966f864ce47d82ebd6316bbcb123927f3280e30"),
    ("LGPL-2.1", "ed875dac9045cba09a17867210991f3a4a82f80b82096b054560a3a8dae9d692"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "a1b36de49a400e3d3385d5987188db954a084f9876243aa7207cd91de3f24a7b"),
    ("MPL-2.0", "075fcdf87448c49dbad8c5f7963f0eb6907a3d8eae1b431ba2988508499ec0de"),
    ("MPL-2.0", "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a"),
]
#: Identifiers and names of licences.
NAMES = {
    "0BSD": ["Zero-Clause BSD License", "BSD Zero Clause License"],
    "AGPL-3.0": ["GNU Affero General Public License", "AGPL"],
    "Apache-2.0": ["Apache License", "Apache Software License"],
    "Artistic-2.0": ["Artistic License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "New BSD License", "Modified BSD License"],
    "BSL-1.0": ["Boost Software License"],
    "CC0-1.0": ["CC0 License", "Creative Commons Zero License"],
    "EPL-2.0": ["Eclipse Public License"],
    "GPL-2.0": ["GNU General Public License", "GNU GPL", "GPL"],
    "GPL-3.0": ["GNU General Public License", "GNU GPL", "GPL"],
    "ISC": ["ISC License"],
    "LGPL-2.1": ["GNU Lesser General Public License", "GNU LGPL", "LGPL"],
    "LGPL-3.0": ["GNU Lesser General Public License", "GNU LGPL", "LGPL"],
    "MIT": ["MIT License"],
    "MPL-2.0": ["Mozilla Public License"],
    "Unlicense": ["Unlicense"],
    "Zlib": ["zlib License"],
}
#: Parts of Creative Commons licences, and the versions of these.
_CC = {"BY": "Attribution", "NC": "NonCommercial", "ND": "NoDerivatives", "SA": "ShareAlike"}
_CC_KINDS, _CC_VERSIONS = ["BY", "BY-SA", "BY-ND", "BY-NC", "BY-NC-SA", "BY-NC-ND"], {"3.0": "Unported", "4.0": "International"}
#: How a notice names its licence.
_PHRASES = ["Licensed", "Released", "Distributed", "Published", "Available", "This work is licensed", "This software is licensed", "This project is licensed", "This program is licensed"]
_ARTICLES = ["under", "under the", "under a", "under the terms of the"]


def _names() -> list[tuple[str, str]]:
    """(identifier, name as notices write it); one with a version in its identifier always names it."""
    out = []
    for key, names in NAMES.items():
        version = key.rpartition("-")[2] if key.rpartition("-")[2][:1].isdigit() else ""
        short = version.removesuffix(".0")
        for name in names:
            if not version or key.startswith("CC0"):
                out += [(key, name), (key, f"{name} {version}")]
            else:
                out += [(key, f"{name}{between}{v}") for v in dict.fromkeys((version, short)) for between in (" ", ", Version ", " v")]
    for kind in _CC_KINDS:
        words = "-".join(_CC[part] for part in kind.split("-"))
        for version, where in _CC_VERSIONS.items():
            spelled = [f"CC {kind} {version}", f"Creative Commons {words} {version}", f"Creative Commons {words} {version} {where}"]
            out += [(f"CC-{kind}-{version}", name + end) for name in spelled for end in ("", " License")]
    return out


def notices() -> list[tuple[str, str]]:
    """(identifier, line) of the notices of all licences: every phrase with every name, and the SPDX line."""
    named = [(key, f"{phrase} {article} {name}") for key, name in _names() for phrase in _PHRASES for article in _ARTICLES]
    return named + [(key, f"SPDX-License-Identifier: {key}{only}") for key in dict.fromkeys(k for k, _ in _names()) for only in ("", "-only", "-or-later")]


#: Every default notice matches this.
LOOKED_UP = r"licen[sc]e|\bunder\b"
#: Fixed value: a line that only states a copyright or reserves rights.
COPYRIGHT_LINE = r"(?m)^[ \t#*/;-]*(copyright[ \t]*(\(c\)|:|©|by |[0-9]{4}|\[yyyy|<year>)|(©|\(c\))[ \t]*[0-9]{4}|all rights reserved)[^\n]*$"


def canonical(text):
    """The text whose digest identifies a licence."""
    out = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT_LINE, "")
    for given, one in SPELLINGS:
        out = F.replace(out, F.lit(given), F.lit(one))
    return F.btrim(F.regexp_replace(out, r"[^\p{L}\p{N}]+", " "))


def digest(text):
    return F.sha2(canonical(text).cast("binary"), 256)


def known(spark: SparkSession, texts: list[tuple[str, str]], digests: list[tuple[str, str]] = ()) -> DataFrame:
    """(license_id, digest) of known texts and known digests, one row for each digest."""
    made = spark.createDataFrame(texts, "license_id string, text string").select("license_id", digest(F.col("text")).alias("digest"))
    given = spark.createDataFrame(list(digests), "license_id string, digest string")
    return made.unionByName(given).groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    texts: list[tuple[str, str]] | None = None, digests: list[tuple[str, str]] | None = None, lines: list[tuple[str, str]] | None = None,
) -> DataFrame:
    """(id, canonical_sha256, license_id, notices): licence of the whole text or null; identifiers of its notice lines, sorted and joined by commas.

    ``texts`` and ``digests`` are the known licences, ``lines`` the known notices, each as (identifier, text or digest).
    """
    spark = docs.sparkSession
    texts, digests, lines = (given if given is not None else default for given, default in ((texts, TEXTS), (digests, DIGESTS), (lines, notices())))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # known notices as one constant map; only lines that can be one are looked up: each says what work is under, or names a licence
    table = "\n".join(f"{r['digest']}\t{r['license_id']}" for r in known(spark, lines).orderBy("digest").collect())
    of_line = F.str_to_map(F.lit(table or "\t"), F.lit("\n"), F.lit("\t"))
    # the filter saves look-ups; a caller's notice that says neither is looked for on every line
    every = all(re.search(LOOKED_UP, line.lower()) for _, line in lines)
    each = F.split(text, "\n")
    naming = F.filter(each, lambda x: F.lower(x).rlike(LOOKED_UP)) if every else each
    found = F.array_sort(F.array_distinct(F.filter(F.transform(naming, lambda x: of_line[digest(x)]), lambda x: x.isNotNull())))
    rows = docs.select(F.col(id_col), digest(text).alias("canonical_sha256"), F.array_join(found, ",").alias("notices"))
    whole = known(spark, texts, digests).withColumnRenamed("digest", "canonical_sha256")
    return rows.join(F.broadcast(whole), "canonical_sha256", "left").select(id_col, "canonical_sha256", "license_id", "notices")
