"""Licence templates (fixed values): names, and notices or whole texts as they are commonly written.

Siblings, which differ by few words, are all held, so that a text comes out as its own licence. Whole texts lie in whole_texts;
those of AGPL-3.0 and of the other CC 4.0 licences are made from their siblings' by the passages in which they differ.
"""

from __future__ import annotations

import pkgutil

_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND'
    " NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,"
    " OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain"
    " the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the"
    " following disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_TAIL = (
    ' THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND'
    " FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL"
    " DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,"
    " WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version."

_LINES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'
        " http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT"
        " WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    (
        "MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction,'
        " including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is"
        " furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        + _WARRANTY,
    ),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL),
    (
        "BSD-3-Clause",
        _BSD_HEAD
        + " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
        + _BSD_TAIL,
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice"
        ' appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.'
        " IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION"
        " OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", _GNU.format("General Public License", "3")),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", _GNU.format("General Public License", "2")),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", _GNU.format("Lesser General Public License", "3")),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", _GNU.format("Affero General Public License", "3")),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or"
        " as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is"
        " granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    ),
)

_CC = {
    "BY": "Attribution",
    "BY-SA": "Attribution-ShareAlike",
    "BY-NC": "Attribution-NonCommercial",
    "BY-NC-SA": "Attribution-NonCommercial-ShareAlike",
    "BY-ND": "Attribution-NoDerivatives",
    "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
}
_CC_SCOPES = {"4.0": "International", "3.0": "Unported", "2.5": "Generic", "2.0": "Generic", "1.0": "Generic"}


def _cc_lines() -> list[tuple[str, str]]:
    out = []
    for version, scope in _CC_SCOPES.items():
        for code, name in _CC.items():
            # Before 4.0 the name was NoDerivs.
            name = name if version == "4.0" else name.replace("Derivatives", "Derivs")
            out.append((f"CC-{code}-{version}", f"Licensed under CC {code} {version}."))
            out.append((f"CC-{code}-{version}", f"This work is licensed under a Creative Commons {name} {version} {scope} License."))
    return out


def _gnu_lines() -> list[tuple[str, str]]:
    out = []
    for short, name, versions in (
        ("GPL", "General", "1 2 3"),
        ("LGPL", "Library General", "2"),
        ("LGPL", "Lesser General", "2.1 3"),
        ("AGPL", "Affero General", "3"),
    ):
        for version in versions.split():
            full = version if "." in version else f"{version}.0"
            notice = _GNU.format(f"{name} Public License", version)
            out.append((f"{short}-{full}", f"This work is licensed under the GNU {name} Public License, version {version}."))
            out += [(f"{short}-{full}", notice), (f"{short}-{full}", notice.replace("program", "library"))]
    return out


def _whole(name: str) -> str:
    return " ".join(pkgutil.get_data("strandlake.llm", f"whole_texts/{name}.txt").decode().split())


def _changed(text: str, *changes: tuple[str, str]) -> str:
    for old, new in changes:
        if old not in text:
            raise ValueError(f"not in the text: {old}")
        text = text.replace(old, new)
    return text


_WHOLE = (
    *("AGPL-3.0", "Apache-2.0", "Artistic-1.0-Perl", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC-BY-NC-SA-4.0", "CC-BY-ND-4.0", "CC-BY-NC-ND-4.0", "CC0-1.0", "EPL-1.0", "GFDL-1.2", "GFDL-1.3"),
    *("GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "MPL-1.1", "MPL-2.0", "NCSA", "OFL-1.1", "Unicode-3.0"),
)
_NC = (
    ("Share means to provide", "NonCommercial means not primarily intended for or directed towards commercial advantage or monetary compensation. For purposes of this Public License, the exchange of the Licensed"
     " Material for other material subject to Copyright and Similar Rights by digital file-sharing or similar means is NonCommercial provided there is no payment of monetary compensation in connection"
     " with the exchange. Share means to provide"),
    ("in whole or in part; and", "in whole or in part, for NonCommercial purposes only; and"),
    ("and Share Adapted Material.", "and Share Adapted Material for NonCommercial purposes only."),
    ("right to collect such royalties.", "right to collect such royalties, including when the Licensed Material is used other than for NonCommercial purposes."),
    ("portion of the contents of the database;", "portion of the contents of the database for NonCommercial purposes only;"),
)
_ND = (
    ("produce, reproduce, and Share Adapted Material", "produce and reproduce, but not Share, Adapted Material"),
    ("If You Share the Licensed Material (including in modified form), You must:", "If You Share the Licensed Material, You must:"),
    ("Section 4 -- Sui Generis", "For the avoidance of doubt, You do not have permission under this Public License to Share Adapted Material. Section 4 -- Sui Generis"),
    ("of the contents of the database", "of the contents of the database, provided You do not Share Adapted Material"),
)
_AFFERO = (
    ("13. Use with the GNU Affero General Public License. Notwithstanding any other provision of this License, you have permission", "13. Remote Network Interaction; Use with the GNU Common Public License."
     " Notwithstanding any other provision of this License, if you modify the Program, your modified version must prominently offer all users interacting with it remotely through a computer network (if"
     " your version supports such interaction) an opportunity to receive the Corresponding Source of your version by providing access to the Corresponding Source from a network server at no charge,"
     " through some standard or customary means of facilitating copying of software. This Corresponding Source shall include the Corresponding Source for any work covered by version 3 of the GNU Common"
     " Public License that is incorporated pursuant to the following paragraph. Notwithstanding any other provision of this License, you have permission"),
    ("under version 3 of the GNU Affero General Public License into", "under version 3 of the GNU Common Public License into"),
    ("but the special requirements of the GNU Affero General Public License, section 13, concerning interaction through a network will apply to the combination as such.", "but the work with which it is"
     " combined will remain governed by version 3 of the GNU Common Public License."),
    ("GNU General Public License", "GNU Affero General Public License"),
    ("GNU GENERAL PUBLIC LICENSE", "GNU AFFERO GENERAL PUBLIC LICENSE"),
    ("GNU Common Public License", "GNU General Public License"),
)


def _whole_texts() -> list[tuple[str, str]]:
    made = {"AGPL-3.0": ("GPL-3.0", _AFFERO)}
    for new, old, changes in (("BY-NC", "BY", _NC), ("BY-NC-SA", "BY-SA", _NC), ("BY-ND", "BY", _ND), ("BY-NC-ND", "BY", _NC + _ND)):
        made[f"CC-{new}-4.0"] = (f"CC-{old}-4.0", ((f"{_CC[old]} 4.0", f"{_CC[new]} 4.0"), *changes))
    return [(name, _changed(_whole(made[name][0]), *made[name][1]) if name in made else _whole(name)) for name in _WHOLE]


TEMPLATES = tuple(dict.fromkeys((*_LINES, *_cc_lines(), *_gnu_lines(), *(("Apache-" + v, f"Licensed under the Apache License, Version {v}.") for v in ("1.0", "1.1")), *_whole_texts())))
