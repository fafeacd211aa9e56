"""Texts of well-known licences, as their authors publish them, and the notices that projects write in file heads."""

from __future__ import annotations

_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
    "subject to the following conditions:"
)
_MIT_REST = (
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH "
    "THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_TWO = (
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_THREE = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_REST = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
    "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT "
    "(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY "
    "SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
    "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, "
    "for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the "
    "public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all "
    "present and future rights to this software under copyright law."
)
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
    "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be "
    "appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
)
_APACHE_HEAD = (
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
    "See the License for the specific language governing permissions and limitations under the License."
)
_APACHE_FILE = (
    "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. \"License\" shall mean the terms and conditions for use, reproduction, "
    "and distribution as defined by Sections 1 through 9 of this document."
)
_MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."


def _gnu_head(name: str, version: str) -> str:
    """The notice that the GNU licences give for the heads of files."""
    return (
        f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or "
        f"(at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
        f"See the GNU {name} for more details. You should have received a copy of the GNU {name} along with this program. If not, see <https://www.gnu.org/licenses/>."
    )


def _gnu_file(name: str, version: str, date: str, years: str) -> str:
    """How the file of a GNU licence begins."""
    return (
        f"GNU {name} Version {version}, {date} Copyright (C) {years} Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
    )


def _gnu(name: str, version: str, date: str, years: str, work: str) -> tuple[str, ...]:
    return (
        f"{work} licensed under the GNU {name}, version {version}.",
        f"{work} licensed under the GNU {name}, version {version} or later.",
        _gnu_head(name, version),
        _gnu_file(name, version, date, years),
    )


def _creative(code: str, words: str) -> tuple[str, ...]:
    return (f"Licensed under CC {code} 4.0.", f"This work is licensed under a Creative Commons {words} 4.0 International License.")


def _spdx(*names: str) -> tuple[str, ...]:
    return tuple(f"SPDX-License-Identifier: {n}" for n in names)


#: Texts by licence; one that resembles any of them has the licence.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", _APACHE_HEAD.partition(" You may obtain")[0], _APACHE_HEAD, _APACHE_FILE, *_spdx("Apache-2.0")),
    "MIT": ("Released under the MIT License.", "This software is licensed under the MIT License.", _MIT_GRANT, f"MIT License {_MIT_GRANT} {_MIT_REST}", *_spdx("MIT")),
    "GPL-2.0": (*_gnu("General Public License", "2", "June 1991", "1989, 1991", "This work is"), *_spdx("GPL-2.0-only", "GPL-2.0-or-later")),
    "GPL-3.0": (*_gnu("General Public License", "3", "29 June 2007", "2007", "This work is"), *_spdx("GPL-3.0-only", "GPL-3.0-or-later")),
    "LGPL-2.1": (*_gnu("Lesser General Public License", "2.1", "February 1999", "1991, 1999", "This library is"), *_spdx("LGPL-2.1-only", "LGPL-2.1-or-later")),
    "LGPL-3.0": (*_gnu("Lesser General Public License", "3", "29 June 2007", "2007", "This library is"), *_spdx("LGPL-3.0-only", "LGPL-3.0-or-later")),
    "AGPL-3.0": (*_gnu("Affero General Public License", "3", "19 November 2007", "2007", "This work is"), *_spdx("AGPL-3.0-only", "AGPL-3.0-or-later")),
    "MPL-2.0": (_MPL, _MPL.partition(" If a copy")[0], *_spdx("MPL-2.0")),
    "BSD-2-Clause": ("Released under the BSD 2-Clause License.", f"{_BSD_HEAD} {_BSD_TWO} {_BSD_REST}", *_spdx("BSD-2-Clause")),
    "BSD-3-Clause": ("Released under the BSD 3-Clause License.", _BSD_HEAD, f"{_BSD_HEAD} {_BSD_TWO} {_BSD_THREE} {_BSD_REST}", *_spdx("BSD-3-Clause")),
    "CC-BY-4.0": (*_creative("BY", "Attribution"), *_spdx("CC-BY-4.0")),
    "CC-BY-SA-4.0": (*_creative("BY-SA", "Attribution-ShareAlike"), *_spdx("CC-BY-SA-4.0")),
    "CC-BY-NC-4.0": (*_creative("BY-NC", "Attribution-NonCommercial"), *_spdx("CC-BY-NC-4.0")),
    "CC0-1.0": ("Dedicated to the public domain under CC0 1.0.", *_spdx("CC0-1.0")),
    "Unlicense": (_UNLICENSE.partition(". ")[0] + ".", _UNLICENSE, *_spdx("Unlicense")),
    "ISC": ("Released under the ISC License.", _ISC, *_spdx("ISC")),
    "Zlib": ("Released under the zlib License.", _ZLIB, *_spdx("Zlib")),
}
