"""Templates of the licence scan: rows of (licence, form, text, words that must stand in a unit).

Forms are ``text`` (the whole licence), ``header`` (what its authors put on top of files), ``notice`` (one sentence) and
``id`` (an SPDX line). Whole texts of more than a page lie in ``licences/``. All are published texts, so fixed values.
"""

from __future__ import annotations

from pathlib import Path
from typing import NamedTuple


class Template(NamedTuple):
    licence: str
    form: str
    text: str
    must: str = ""


#: One-sentence notices.
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Use of this source code is governed by the BSD 3-Clause License.",
    "CC-BY-4.0": "This work is licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-2.1": "Licensed under the GNU Lesser General Public License, version 2.1.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "Subject to the terms of the Mozilla Public License, v. 2.0.",
}
#: Words without which a notice or a header does not name its licence.
MUST = {
    "AGPL-3.0": "affero general public 3",
    "Apache-2.0": "apache 2",
    "BSD-2-Clause": "bsd 2",
    "BSD-3-Clause": "bsd 3",
    "BSL-1.0": "boost 1",
    "CC-BY-4.0": "by 4",
    "CC-BY-NC-4.0": "by nc 4",
    "GPL-2.0": "gnu general public 2",
    "GPL-3.0": "gnu general public 3",
    "LGPL-2.1": "gnu lesser general public 2 1",
    "LGPL-3.0": "gnu lesser general public 3",
    "MIT": "mit",
    "MPL-2.0": "mozilla public 2 0",
}
#: SPDX ids.
IDS = [
    "0BSD", "AGPL-3.0", "Apache-2.0", "Artistic-1.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC0-1.0",
    "GPL-1.0", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-1.1", "MPL-2.0", "Unlicense", "Zlib",
]
#: Endings that the ids of the GNU licences take.
GNU_ENDINGS = ["", "-only", "-or-later", "+"]

_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE
OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_GRANT = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution."""
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from
this software without specific prior written permission."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER
OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE,
EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF
OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the
"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""

#: Whole texts of at most a page.
TEXTS = {
    "0BSD": f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n{_ISC_END}",
    "BSD-2-Clause": f"{_BSD_GRANT}\n{_BSD_END}",
    "BSD-3-Clause": f"{_BSD_GRANT}\n{_BSD_THIRD}\n{_BSD_END}",
    "BSL-1.0": """Boost Software License - Version 1.0
Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation
covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative
works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following
disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies
or derivative works are solely in the form of machine-executable object code generated by a source language processor.""",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
           f"the above copyright notice and this permission notice appear in all copies.\n{_ISC_END}",
    "MIT": f"{_MIT_GRANT}\n{_AS_IS}",
    "Unlicense": f"""This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary,
for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software
to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We
intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
{_AS_IS}""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any
damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in
a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
}


def _gnu_header(name: str, version: str) -> str:
    return f"""This program is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the
Free Software Foundation, either version {version} of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details.
You should have received a copy of the {name} along with this program. If not, see <https://www.gnu.org/licenses/>."""


#: Names and versions as the GNU headers spell them.
GNU = {
    "AGPL-3.0": ("GNU Affero General Public License", "3"),
    "GPL-2.0": ("GNU General Public License", "2"),
    "GPL-3.0": ("GNU General Public License", "3"),
    "LGPL-2.1": ("GNU Lesser General Public License", "2.1"),
    "LGPL-3.0": ("GNU Lesser General Public License", "3"),
}
#: Headers of other licences.
HEADERS = {
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations
under the License.""",
    "BSL-1.0": """Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at
http://www.boost.org/LICENSE_1_0.txt)""",
    "MIT": "Use of this source code is governed by an MIT-style license that can be found in the LICENSE file.",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed
with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
}


def templates() -> list[Template]:
    """All rows, by licence and form."""
    out = [Template(k, "notice", v, MUST[k]) for k, v in NOTICES.items()]
    out += [Template(k, "header", v, MUST[k]) for k, v in HEADERS.items()]
    for licence, (name, version) in GNU.items():
        whole = _gnu_header(name, version)
        later = ", or (at your option) any later version"
        only = whole.replace(f"either version {version}", f"version {version}").replace(later, "")
        out += [Template(licence, "header", t, MUST[licence]) for t in (whole, only)]
        # its first sentence alone, as in files that name only the grant
        out += [Template(licence, "notice", t.split("\nThis program is distributed")[0], MUST[licence]) for t in (whole, only)]
    out += [Template(k, "text", v) for k, v in TEXTS.items()]
    files = sorted(Path(__file__).with_name("licences").glob("*.txt"))
    out += [Template(f.stem, "text", f.read_text("utf-8")) for f in files]
    for k in IDS:
        for ending in GNU_ENDINGS if "GPL" in k else [""]:
            out.append(Template(k, "id", f"SPDX-License-Identifier: {k}{ending}", f"spdx:{k}{ending}".lower()))
    return sorted(out)
