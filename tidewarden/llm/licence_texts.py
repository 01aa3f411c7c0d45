"""Short public licence texts and one-line notices, as published."""

_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO '
    "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
    "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
    "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS "
    "IN THE SOFTWARE."
)
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
    "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
    "permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\n"
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of "
    "the Software.\n\n" + _WARRANTY
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
    "granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n"
)
_ISC_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING '
    "ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, "
    "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
    "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE "
    "OR PERFORMANCE OF THIS SOFTWARE."
)
_ZERO_BSD = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
    "granted.\n\n"
)
_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met:\n\n"
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
    "disclaimer.\n\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
    "following disclaimer in the documentation and/or other materials provided with the distribution.\n\n"
)
_BSD_THIRD = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission.\n\n"
)
_BSD_WARRANTY = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, '
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
    "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_APACHE_NOTICE = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with '
    "the License. You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless required "
    "by applicable law or agreed to in writing, software distributed under the License is distributed on an "
    '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the '
    "specific language governing permissions and limitations under the License."
)

KNOWN: dict[str, list[str]] = {
    "0BSD": [_ZERO_BSD + _ISC_WARRANTY, "BSD Zero Clause License\n\n" + _ZERO_BSD + _ISC_WARRANTY],
    "Apache-2.0": [
        _APACHE_NOTICE,
        "Licensed under the Apache License, Version 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "BSD-2-Clause": [
        _BSD_HEAD + _BSD_WARRANTY,
        "BSD 2-Clause License\n\n" + _BSD_HEAD + _BSD_WARRANTY,
        "SPDX-License-Identifier: BSD-2-Clause",
    ],
    "BSD-3-Clause": [
        _BSD_HEAD + _BSD_THIRD + _BSD_WARRANTY,
        "BSD 3-Clause License\n\n" + _BSD_HEAD + _BSD_THIRD + _BSD_WARRANTY,
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "SPDX-License-Identifier: CC-BY-4.0"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "SPDX-License-Identifier: GPL-2.0-only",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "SPDX-License-Identifier: GPL-3.0-only",
    ],
    "ISC": [_ISC + _ISC_WARRANTY, "ISC License\n\n" + _ISC + _ISC_WARRANTY, "SPDX-License-Identifier: ISC"],
    "MIT": [_MIT, "MIT License\n\n" + _MIT, "Released under the MIT License.", "SPDX-License-Identifier: MIT"],
}

# SHA-256 of the canonical form of whole texts, too long to be held here: as published, and where the text marks the end of
# its terms also without what follows. Taken from the files of these names in /usr/share/common-licenses.
DIGESTS: dict[str, list[str]] = {
    "Apache-2.0": [
        "7e0e7964aedd0da55b18c5d3c0b8c8e4b051b491c8277d3b3540f5a36b54d8a3",
        "408d79782772308fe7ec4aeb2f0b2f9a28dcf9246ddcf0755c43e4d3fb4efa11",
    ],
    "CC0-1.0": [
        "09760a018415968611032b4a83c8cb4fd8fc31aee9c946b00298b1f8c2a77042",
    ],
    "GPL-1.0": [
        "b4682db315c225ec5b1ad1b3d51d141e802dd30b877f9ca1c4390486a46a60c1",
        "5337e0fb41ac565b74d17b266a2c91c0a9b6ed4b17c3c0cbccd4f1ba7f01491b",
    ],
    "GPL-2.0": [
        "0a50f3942e5e965c39dfaf9420fab31fbbeaabccd90b86271a1eea7ca51c45ab",
        "f720a467cb59ad5a4cdc41e8b34c91f4b8840c912ccdc625dec5953b950b82bb",
    ],
    "GPL-3.0": [
        "ea70bedcb83a4361b0bbf5c99767703ee85319062fbb4e9f847bbca0f38491ac",
        "842fccbaaaa15a4e6a2b744f7be5205435cc2d3cb8d13e79f46edbe79a3369e2",
    ],
    "LGPL-2.0": [
        "e6b557c836da67fa721172bd7f54e0cad02c6ffe1621ad4fd1d2823a1ed0cd29",
        "25f7e085a18d4bc8e4f6578b66c5b06dc1c91ba68fdeec775b6541a58ea17557",
    ],
    "LGPL-2.1": [
        "73f8771023a7bd97f99604cee25be5ea96b506e8a15023953726f00bcf5e8cf9",
        "4c0e31071a3387f7e9a25974f05a970bc237220ca37b4f43dc9a1103959048aa",
    ],
    "LGPL-3.0": [
        "91b5d3e9e307d305f7c91670699dcefa38a95bc0127f171027869fadcae9f986",
    ],
    "MPL-1.1": [
        "c8802068f341d2f237ee9b8db4dc5a3e630fb0a14e92e322092ca9d5e33ad0ee",
    ],
    "MPL-2.0": [
        "d1285e24f50300efc71e8addfb6cc3c21c6fe504cb51c372d394245f4e1d1a56",
    ],
}
