"""Templates of the license scan: (label, text), one label per licence and version.

Notices that come in many names and versions are made from rules; short licences are given whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

# Wordings of public licences and of the notices that they ask for.
MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files (the \"Software\"), to deal in the Software without restriction"
)
MIT_RIGHTS = (
    ", including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
    "copies of the Software, and to permit persons to whom the Software is furnished to do so"
)
MIT_CONDITION = (
    ", subject to the following conditions: The above copyright notice and this permission notice shall be included in "
    "all copies or substantial portions of the Software."
)
MIT_WARRANTY = (
    " THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO "
    "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
    "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, "
    "TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
BSD_GRANT = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met:"
)
BSD_TWO = (
    " 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
    "following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of "
    "conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
BSD_THIRD = (
    " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission."
)
BSD_WARRANTY = (
    " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
    "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
ISC_CONDITION = ", provided that the above copyright notice and this permission notice appear in all copies"
ISC_WARRANTY = (
    ". THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING "
    "ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, "
    "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
    "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE "
    "OR PERFORMANCE OF THIS SOFTWARE."
)
ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
    "liable for any damages arising from the use of this software. Permission is granted to anyone to use this software "
    "for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the "
    "following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote "
    "the original software. If you use this software in a product, an acknowledgment in the product documentation would "
    "be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be "
    "misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
)
UNLICENSE = (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, "
    "use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
    "purpose, commercial or non-commercial, and by any means."
)
BOOST = (
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and "
    "accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, "
    "execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to "
    "whom the Software is furnished to do so"
)
CC0 = (
    "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"
)
MPL_2 = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"
MPL_11 = "The contents of this file are subject to the Mozilla Public License Version 1.1"
WHOLE = (
    ("mit", "released under the MIT license"),
    ("mit", MIT_GRANT),
    ("mit", MIT_GRANT + MIT_RIGHTS + MIT_CONDITION + MIT_WARRANTY),
    ("mit-0", MIT_GRANT + MIT_RIGHTS + "." + MIT_WARRANTY),
    ("bsd", BSD_GRANT),
    ("bsd-2", BSD_GRANT + BSD_TWO + BSD_WARRANTY),
    ("bsd-3", BSD_GRANT + BSD_TWO + BSD_THIRD + BSD_WARRANTY),
    ("isc", ISC_GRANT + ISC_CONDITION),
    ("isc", ISC_GRANT + ISC_CONDITION + ISC_WARRANTY),
    ("0bsd", ISC_GRANT + ISC_WARRANTY),
    ("zlib", ZLIB),
    ("unlicense", UNLICENSE),
    ("bsl-1", BOOST),
    ("cc0-1.0", CC0),
    ("mpl-2", MPL_2),
    ("mpl-1.1", MPL_11),
)
APACHE = {"apache-1.1": "1.1", "apache-2": "2.0"}
#: Elements of a Creative Commons licence with their spellings, and the licences made of them.
CC_WORDS = {"by": ("Attribution",), "nc": ("NonCommercial", "Non Commercial"), "sa": ("ShareAlike", "Share Alike"),
            "nd": ("NoDerivatives", "NoDerivs", "No Derivatives")}
CC_LICENCES = (("by",), ("by", "sa"), ("by", "nc"), ("by", "nd"), ("by", "nc", "sa"), ("by", "nc", "nd"))
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
#: Names of the GNU licences with their versions.
GNU = {"gpl": ("General Public License", ("1", "2", "3")), "lgpl": ("Lesser General Public License", ("2", "2.1", "3")),
       "agpl": ("Affero General Public License", ("1", "3"))}
#: Identifiers that stand in file headers, with the labels they stand for.
IDENTIFIERS = {"MIT": "mit", "MIT-0": "mit-0", "ISC": "isc", "0BSD": "0bsd", "BSD-2-Clause": "bsd-2", "BSD-3-Clause": "bsd-3",
               "Zlib": "zlib", "Unlicense": "unlicense", "BSL-1.0": "bsl-1", "CC0-1.0": "cc0-1.0", "MPL-1.1": "mpl-1.1",
               "MPL-2.0": "mpl-2", "Apache-1.1": "apache-1.1", "Apache-2.0": "apache-2"}


def creative_commons() -> Iterator[tuple[str, str]]:
    for parts, version in product(CC_LICENCES, CC_VERSIONS):
        code = "-".join(parts)
        label = f"cc-{code}-{version}"
        for spelling in product(*(CC_WORDS[p] for p in parts)):
            yield label, f"Creative Commons {' '.join(spelling)} {version}"
        yield label, f"CC {code} {version}"
        yield label, f"creativecommons.org/licenses/{code}/{version}"


def gnu() -> Iterator[tuple[str, str]]:
    program = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation"
    for code, (name, versions) in GNU.items():
        yield code, program.format(name)
        if code != "gpl":  # the bare name of the GPL is within the names of the others
            yield code, f"GNU {name}"
        for version in versions:
            label = f"{code}-{version}"
            yield label, f"This work is licensed under the GNU {name} version {version}"
            yield label, f"{program.format(name)}; either version {version} of the License"
            number = version if "." in version else f"{version}.0"
            yield label, f"SPDX-License-Identifier: {code}-{number}"
            for until in ("only", "or later"):
                yield label, f"SPDX-License-Identifier: {code}-{number} {until}"
            if code != "gpl":
                yield label, f"GNU {name} version {version}"


def notices() -> tuple[tuple[str, str], ...]:
    """All templates of the scan."""
    apache = [(label, f"Licensed under the Apache License, Version {v} (the License); you may not use this file except in compliance with the License")
              for label, v in APACHE.items()]
    identifiers = [(label, f"SPDX-License-Identifier: {name}") for name, label in IDENTIFIERS.items()]
    return (*WHOLE, *apache, *creative_commons(), *gnu(), *identifiers)
