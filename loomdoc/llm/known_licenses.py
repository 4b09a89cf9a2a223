"""Known licence texts and notices (fixed values), without their copyright lines."""

from __future__ import annotations

from pathlib import Path

# fixed values: spellings that count as the same, longest first where one holds another
EQUIVALENT = {
    "https://": "http://",
    "acknowledgement": "acknowledgment",
    "artefact": "artifact",
    "authorisation": "authorization",
    "authorised": "authorized",
    "catalogue": "catalog",
    "centre": "center",
    "favour": "favor",
    "fulfil ": "fulfill ",
    "judgement": "judgment",
    "labour": "labor",
    "licence": "license",
    "merchantibility": "merchantability",
    "noncommercial": "non-commercial",
    "organisation": "organization",
    "organise": "organize",
    "per cent": "percent",
    "programme": "program",
    "recognise": "recognize",
    "sub-license": "sublicense",
    "sub license": "sublicense",
    "utilisation": "utilization",
    "whilst": "while",
    "wilful": "willful",
}

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_1 = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_2 = "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_WARRANTY = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

TEXTS = {
    "MIT": [_MIT, "MIT License\n\n" + _MIT, "The MIT License\n\n" + _MIT, "The MIT License (MIT)\n\n" + _MIT],
    "ISC": [f"{x}{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_WARRANTY}" for x in ("", "ISC License\n\n", "The ISC License\n\n")],
    "0BSD": [f"{x}{_ISC_GRANT}.\n\n{_ISC_WARRANTY}" for x in ("", "BSD Zero Clause License\n\n", "Zero-Clause BSD\n\n")],
    "BSD-2-Clause": [f"{x}{_BSD_HEAD}\n\n{_BSD_1}\n\n{_BSD_2}\n\n{_BSD_WARRANTY}" for x in ("", "BSD 2-Clause License\n\n")],
    "BSD-3-Clause": [f"{x}{_BSD_HEAD}\n\n{_BSD_1}\n\n{_BSD_2}\n\n{_BSD_3}\n\n{_BSD_WARRANTY}" for x in ("", "BSD 3-Clause License\n\n")],
}

NOTICES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0"],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "SPDX-License-Identifier: MIT"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under CC BY 4.0.", "SPDX-License-Identifier: CC-BY-4.0"],
}

_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""

#: TEXTS, and the other licences whose words are held here in full, with the files of license_texts.
ALL_TEXTS = TEXTS | {
    "Unlicense": [f"{_UNLICENSE}\n\n{x}" for x in ("", "For more information, please refer to <http://unlicense.org/>", "For more information, please refer to <http://unlicense.org>")],
    "Zlib": [f"{x}{_ZLIB}" for x in ("", "zlib License\n\n", "The zlib License\n\n")],
    **{f.stem: [f.read_text()] for f in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))},
}

_LEADS = [f"{x}{y} under" for x in ("", "this work is ", "this program is ", "this project is ", "this software is ", "this file is ", "this document is ") for y in ("licensed", "released", "distributed")]
_LEADS += [f"{x} the terms of" for x in _LEADS]
# fixed values: names by licence; an id without a version is that of a notice that gives none
_VERSIONS = {
    "GPL": ("GNU General Public License", ["2.0", "3.0"]),
    "LGPL": ("GNU Lesser General Public License", ["2.1", "3.0"]),
    "AGPL": ("GNU Affero General Public License", ["3.0"]),
    "GFDL": ("GNU Free Documentation License", ["1.2", "1.3"]),
    "Apache": ("Apache License", ["1.1", "2.0"]),
    "MPL": ("Mozilla Public License", ["1.1", "2.0"]),
    "EPL": ("Eclipse Public License", ["1.0", "2.0"]),
    "EUPL": ("European Union Public License", ["1.1", "1.2"]),
    "CDDL": ("Common Development and Distribution License", ["1.0", "1.1"]),
    "AFL": ("Academic Free License", ["3.0"]),
    "OSL": ("Open Software License", ["3.0"]),
    "BSL": ("Boost Software License", ["1.0"]),
    "Artistic": ("Artistic License", ["1.0", "2.0"]),
}
_NAMES = {
    "MIT": ["MIT License", "MIT"], "MIT-0": ["MIT No Attribution License", "MIT-0"], "ISC": ["ISC License", "ISC"], "0BSD": ["Zero-Clause BSD License", "BSD Zero Clause License", "0BSD"],
    "BSD": ["BSD License"], "BSD-2-Clause": ["BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License", "BSD-2-Clause"],
    "BSD-3-Clause": ["BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License", "BSD-3-Clause"],
    "Unlicense": ["Unlicense"], "Zlib": ["zlib License"], "WTFPL": ["WTFPL"], "CC0-1.0": ["CC0 1.0", "CC0 1.0 Universal", "Creative Commons CC0 1.0 Universal", "CC0-1.0"], "Python-2.0": ["Python Software Foundation License", "Python License 2.0"],
}
_CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives", "BY-NC": "Attribution-NonCommercial", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}


def _names() -> dict[str, list[str]]:
    out = {k: list(v) for k, v in _NAMES.items()}
    for short, (name, versions) in _VERSIONS.items():
        gnu = [f"GNU {short}"] if name.startswith("GNU") else []
        out[short] = [name, short, f"{short} License", *gnu]
        for v in versions:
            spelt = {v, v.removesuffix(".0")}
            out[f"{short}-{v}"] = [f"{n}{x}{w}" for n in (name, short, *gnu) for w in spelt for x in (", version ", " ", " v", "-", "v")] + [f"{short} {w} License" for w in spelt]
    for short, name in _CC.items():
        for v in ("2.0", "2.5", "3.0", "4.0"):
            full = [f"Creative Commons {name} {v}{x}" for x in ("", " International", " Unported", " Generic")]
            out[f"CC-{short}-{v}"] = [f"CC {short} {v}", f"CC-{short}-{v}", *full, *[f"{x} License" for x in full], f"Creative Commons {short} {v}"]
    return out


def _all_notices() -> dict[str, list[str]]:
    out = {k: list(v) for k, v in NOTICES.items()}
    for id_, names in _names().items():
        spdx = [f"SPDX-License-Identifier: {id_}{x}" for x in (("", "-only", "-or-later", "+") if "GPL-" in id_ or "GFDL-" in id_ else ("",))]
        out[id_] = list(dict.fromkeys([*out.get(id_, []), *[f"{lead} {the}{n}." for lead in _LEADS for the in ("", "the ") for n in names], *spdx]))
    return out


#: NOTICES, and each lead-in with each name of each licence.
ALL_NOTICES = _all_notices()
