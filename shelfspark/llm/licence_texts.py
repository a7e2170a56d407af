"""Known licence texts and notices by SPDX identifier, and equivalent spellings (patterns of canonical words)."""

from __future__ import annotations

import re
from importlib import resources

EQUIVALENT_SPELLINGS = (
    ("sub licen[cs]e", "sublicense"), ("sublicence", "sublicense"), ("licence", "license"), ("licenced", "licensed"), ("licences", "licenses"),
    ("licencing", "licensing"), ("acknowledgement", "acknowledgment"), ("acknowledgements", "acknowledgments"), ("authorised", "authorized"),
    ("behaviour", "behavior"), ("catalogue", "catalog"), ("centre", "center"), ("copyright owner", "copyright holder"),
    ("copyright owners", "copyright holders"), ("favour", "favor"), ("fulfil", "fulfill"), ("initialise", "initialize"), ("judgement", "judgment"),
    ("labour", "labor"), ("merchantibility", "merchantability"), ("modelled", "modeled"), ("non commercial", "noncommercial"),
    ("non infringement", "noninfringement"), ("organisation", "organization"), ("per cent", "percent"), ("programme", "program"),
    ("recognise", "recognize"), ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"),
)

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

_ISC_TERMS = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

""" + _ISC_TERMS

_ZERO_BSD = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

""" + _ISC_TERMS

_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""

_BSD_TAIL = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

_BSD_THIRD = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""

_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""

_APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""


def _named(spdx: str, *names: str) -> list[str]:
    """The usual one-line notices for a licence, by its names and its identifier."""
    forms = ("Licensed under {}.", "Licensed under the {}.", "Released under the {}.", "This work is licensed under {}.", "This work is licensed under the {}.")
    return [f.format(name) for name in names for f in forms] + [f"SPDX-License-Identifier: {spdx}"]


def _full(spdx: str) -> list[str]:
    """The full text of a licence in its usual forms: with and without the appendix on its use, with http and https, and as lines, paragraphs or one line.

    Layouts count because a copyright line is left out as a whole line, and "(c)" in front of a clause reads as one.
    """
    whole = resources.files("shelfspark.llm").joinpath("licence_files", f"{spdx}.txt").read_text("utf-8").replace("\f", "\n")
    end = re.search("END OF TERMS AND CONDITIONS", whole)
    forms = {whole, *([whole[:end.start()], whole[:end.end()]] if end else [])}
    forms |= {f.replace("https:", "http:") for f in forms} | {re.sub("https?:", "https:", f) for f in forms}
    paragraphs = {"\n\n".join(" ".join(part.split()) for part in re.split(r"\n\s*\n", f)) for f in forms}
    return sorted(forms | paragraphs | {" ".join(f.split()) for f in forms})


KNOWN_TEXTS: dict[str, list[str]] = {
    "MIT": [_MIT, "MIT License\n\n" + _MIT, "The MIT License\n\n" + _MIT, "The MIT License (MIT)\n\n" + _MIT, *_named("MIT", "MIT License")],
    "ISC": [_ISC, "ISC License\n\n" + _ISC, *_named("ISC", "ISC License")],
    "0BSD": [_ZERO_BSD, "BSD Zero Clause License\n\n" + _ZERO_BSD, *_named("0BSD", "BSD Zero Clause License")],
    "BSD-2-Clause": [_BSD_HEAD + _BSD_TAIL, "BSD 2-Clause License\n\n" + _BSD_HEAD + _BSD_TAIL, *_named("BSD-2-Clause", "BSD 2-Clause License")],
    "BSD-3-Clause": [_BSD_HEAD + _BSD_THIRD + _BSD_TAIL, "BSD 3-Clause License\n\n" + _BSD_HEAD + _BSD_THIRD + _BSD_TAIL,
                     *_named("BSD-3-Clause", "BSD 3-Clause License")],
    "Zlib": [_ZLIB, "zlib License\n\n" + _ZLIB, *_named("Zlib", "zlib License")],
    "Apache-2.0": [*_full("Apache-2.0"), _APACHE_NOTICE, *_named("Apache-2.0", "Apache License, Version 2.0", "Apache License 2.0")],
    "GPL-2.0-only": [*_full("GPL-2.0-only"), *_named("GPL-2.0-only", "GNU General Public License, version 2")],
    "GPL-3.0-only": [*_full("GPL-3.0-only"), *_named("GPL-3.0-only", "GNU General Public License, version 3")],
    "LGPL-2.1-only": [*_full("LGPL-2.1-only"), *_named("LGPL-2.1-only", "GNU Lesser General Public License, version 2.1")],
    "LGPL-3.0-only": [*_full("LGPL-3.0-only"), *_named("LGPL-3.0-only", "GNU Lesser General Public License, version 3")],
    "AGPL-3.0-only": _named("AGPL-3.0-only", "GNU Affero General Public License, version 3"),
    "MPL-2.0": [*_full("MPL-2.0"), *_named("MPL-2.0", "Mozilla Public License, version 2.0")],
    "CC0-1.0": [*_full("CC0-1.0"), "To the extent possible under law, the author has dedicated this work to the public domain.", *_named("CC0-1.0", "CC0 1.0")],
    "CC-BY-4.0": _named("CC-BY-4.0", "CC BY 4.0", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": _named("CC-BY-SA-4.0", "CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": _named("CC-BY-NC-4.0", "CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
}
