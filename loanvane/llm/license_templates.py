"""License wording as templates with optional and replaceable regions.

``<<beginOptional>>`` and ``<<endOptional>>`` enclose wording that may be missing, and may be nested; ``<<var;max=n>>``
stands for up to ``n`` words of any kind. All other words have to be there, in this order and with nothing between them.
"""

# Public license texts and notices, as (label, template).
_MIT = """
<<beginOptional>>the mit license <<beginOptional>>mit<<endOptional>><<endOptional>>
<<beginOptional>>copyright <<beginOptional>>c<<endOptional>> <<var;max=20>><<endOptional>>
Permission is hereby granted, free of charge, to any person obtaining a copy of <<var;max=6>> (the "Software"), to deal in
the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute,
sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to
the following conditions: The above copyright notice and this permission notice
<<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or substantial portions of
the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL <<var;max=12>> BE
LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF
OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
"""
_ISC = """
<<beginOptional>>isc license<<endOptional>>
<<beginOptional>>copyright <<beginOptional>>c<<endOptional>> <<var;max=20>><<endOptional>>
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND <<var;max=10>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<var;max=10>> BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
SOFTWARE.
"""
_BSD_HEAD = """
<<beginOptional>>copyright <<beginOptional>>c<<endOptional>> <<var;max=20>><<endOptional>>
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: <<beginOptional>>1<<endOptional>> Redistributions of source code must retain the above copyright notice,
this list of conditions and the following disclaimer. <<beginOptional>>2<<endOptional>> Redistributions in binary form must
reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
materials provided with the distribution.
"""
_BSD_NAMES = """
<<beginOptional>>3<<endOptional>> Neither the name of <<var;max=12>> nor the names of its contributors may be used to endorse
or promote products derived from this software without specific prior written permission.
"""
_BSD_TAIL = """
THIS SOFTWARE IS PROVIDED BY <<var;max=12>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<var;max=12>>
BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON
ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY
WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
_APACHE = """
<<beginOptional>>copyright <<var;max=20>><<endOptional>>
Licensed under the Apache License, Version 2.0 (the "License"); you may not use <<var;max=4>> except in compliance with the
License. You may obtain a copy of the License at <<beginOptional>>http<<beginOptional>>s<<endOptional>> www apache org licenses
LICENSE-2.0<<endOptional>> Unless required by applicable law or agreed to in writing, software distributed under the License is
distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for
the specific language governing permissions and limitations under the License.
"""
_MPL = """
This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed
with this file, You can obtain one at <<var;max=8>>
"""

TEMPLATES = [
    ("mit", _MIT),
    ("mit", "<<beginOptional>>this work is<<endOptional>> <<beginOptional>>released<<endOptional>> under the <<beginOptional>>terms of the<<endOptional>> MIT License"),
    ("isc", _ISC),
    ("bsd-2-clause", _BSD_HEAD + _BSD_TAIL),
    ("bsd-3-clause", _BSD_HEAD + _BSD_NAMES + _BSD_TAIL),
    ("apache-2.0", _APACHE),
    ("apache-2.0", "Licensed under the <<beginOptional>>terms of the<<endOptional>> Apache License, <<beginOptional>>Version<<endOptional>> 2.0"),
    ("mpl-2.0", _MPL),
    ("gpl-2.0", "GNU General Public License <<beginOptional>>as published by the Free Software Foundation<<endOptional>> <<beginOptional>>either<<endOptional>> version 2"),
    ("gpl-3.0", "GNU General Public License <<beginOptional>>as published by the Free Software Foundation<<endOptional>> <<beginOptional>>either<<endOptional>> version 3"),
]

# Creative Commons notices: one for each set of conditions.
CONDITIONS = ["by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd"]
TEMPLATES += [
    (f"cc-{c}-4.0", f"licensed under <<beginOptional>>the<<endOptional>> <<beginOptional>>a<<endOptional>> <<beginOptional>>creative commons license<<endOptional>> cc {c} 4.0")
    for c in CONDITIONS
]

# Identifier lines of source files.
IDENTIFIERS = [
    ("mit", "mit"), ("isc", "isc"), ("bsd-2-clause", "bsd-2-clause"), ("bsd-3-clause", "bsd-3-clause"), ("apache-2.0", "apache-2.0"),
    ("mpl-2.0", "mpl-2.0"), ("gpl-2.0", "gpl-2.0"), ("gpl-3.0", "gpl-3.0"),
]
TEMPLATES += [(label, f"SPDX-License-Identifier: {name}") for label, name in IDENTIFIERS]

# Phrases whose mention names a license without its wording, as (phrase, label).
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
