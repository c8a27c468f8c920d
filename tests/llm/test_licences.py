"""Licence sentences against the DuckDB twin and by hand."""

import duckdb

from fieldlink.llm.licences import oracle, scan

ROWS = [
    (1, None), (2, ""), (3, "Text.\nLicensed under the Apache License, Version 2.0."), (4, "RELEASED under the MIT license! Permission is hereby granted, free of charge, to any person obtaining a copy; x"),
    (5, "This program is free software. You can redistribute it and/or modify it under the terms of the GNU General Public License."), (6, "A license is not here. All rights reserved"),
    (7, "Licensed under CC BY-NC 4.0.\r\nReleased under the MIT License."), (7, "Licensed under CC BY-NC 4.0.\r\nReleased under the MIT License."), (None, "word " * 20000 + "\nAll rights reserved."), (8, "licensed under the mit licenses."),
]


def test_scan_equals_twin(spark):
    docs = spark.createDataFrame([(i, t, "x", "-") for i, t in ROWS], "doc_id long, text string, licences string, _run string")
    got = sorted(map(tuple, scan(docs).collect()), key=str)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", ROWS)
    assert got == sorted(con.execute(oracle()).fetchall(), key=str)
    names = {i: n for i, _, _, n in got}
    assert (names[3], names[4], names[5], names[6], names[7], names[8]) == ("Apache-2.0", "MIT", "GPL", "Proprietary", "MIT,CC-BY-NC-4.0", "")
    assert scan(docs.limit(0)).count() == 0


# Licence notices word for word.
APACHE = """/*
 * Copyright 2020 Some Name
 *
 * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 * You may obtain a copy of the License at
 *
 *     http://www.apache.org/licenses/LICENSE-2.0
 *
 * Unless required by applicable law or agreed to in writing, software
 * distributed under the License is distributed on an "AS IS" BASIS,
 * WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
 * See the License for the specific language governing permissions and
 * limitations under the License.
 */"""
MIT = """MIT License

Copyright (c) 2020 Some Name

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""
BSD = """# Copyright (c) 2020, Some Name
# All rights reserved.
#
# Redistribution and use in source and binary forms, with or without
# modification, are permitted provided that the following conditions are met:
#
# 1. Redistributions of source code must retain the above copyright notice, this
#    list of conditions and the following disclaimer.
#
# 2. Redistributions in binary form must reproduce the above copyright notice,
#    this list of conditions and the following disclaimer in the documentation
#    and/or other materials provided with the distribution.
#
# 3. Neither the name of the copyright holder nor the names of its
#    contributors may be used to endorse or promote products derived from
#    this software without specific prior written permission.
#
# THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
# AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
# IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
# DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
# FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
# DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
# SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
# CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
# OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
# OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
GNU = """    This {thing} is free software{mark} you can redistribute it and/or modify
    it under the terms of the GNU {kind}General Public License as published by
    the Free Software Foundation{sep} either version {v} of the License, or
    (at your option) any later version.

    This {thing} is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU {kind}General Public License for more details.

    You should have received a copy of the GNU {kind}General Public License
    along with this {thing}.  If not, see <https://www.gnu.org/licenses/>."""
MPL = """// This Source Code Form is subject to the terms of the Mozilla Public
// License, v. 2.0. If a copy of the MPL was not distributed with this
// file, You can obtain one at https://mozilla.org/MPL/2.0/."""
CC = """This work is licensed under the Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License. To view a copy
of this license, visit http://creativecommons.org/licenses/by-nc-sa/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA."""
BSD_2 = "\n".join(x for x in BSD.split("\n#\n") if "3. Neither" not in x)
BSD_4 = BSD.replace("# 3. Neither", "# 3. All advertising materials mentioning features or use of this software must\n#    display the following acknowledgement: This product includes software\n#    developed by Some Name and its contributors.\n#\n# 4. Neither")
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""
ZLIB = """Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:"""
UNLICENSE = "This is free and unencumbered software released into the public domain."
EPL = """/* This program and the accompanying materials are made available under
 * the terms of the Eclipse Public License v. 2.0.
 */"""
NOTICES = {
    "BSD-2-Clause": (BSD_2, "Ldpqtu"), "BSD-4-Clause": (BSD_4, "Ldpqrstu"), "ISC": (ISC, None), "Zlib": (ZLIB, None), "Unlicense": (UNLICENSE, None), "EPL-2.0": (EPL, None),
    "BSL-1.0": ("Boost Software License - Version 1.0 - August 17th, 2003", None), "0BSD": (ISC.split(", provided")[0] + ".", None),
    "Apache-2.0": (APACHE, "AKJBE"), "MIT": (MIT, None), "BSD-3-Clause": (BSD, "Ldpqstu"), "MPL-2.0": (MPL, None), "CC-BY-NC-SA-4.0": (CC, None),
    "GPL-3.0": (GNU.format(thing="program", mark=":", kind="", sep=",", v="3"), None),
    "GPL-2.0": (GNU.format(thing="program", mark=";", kind="", sep=";", v="2"), None),
    "LGPL-2.1": (GNU.format(thing="library", mark=";", kind="Lesser ", sep=";", v="2.1"), None),
    "AGPL-3.0": (GNU.format(thing="program", mark=":", kind="Affero ", sep=",", v="3"), None),
}
LINES = {
    "SPDX-License-Identifier: Apache-2.0": "Apache-2.0", "// SPDX-License-Identifier: GPL-2.0-or-later": "GPL-2.0", "License: MIT": "MIT", "The MIT License (MIT)": "MIT",
    "BSD 3-Clause License": "BSD-3-Clause", "This project is licensed under the MIT License.": "MIT", "Licensed under CC BY-SA 3.0.": "CC-BY-SA-3.0", "Mozilla Public License, v. 2.0": "MPL-2.0",
    "Creative Commons Attribution 4.0 International Public License": "CC-BY-4.0", "Released under the GNU GPLv3.": "GPL-3.0", "Available under the MIT": "MIT", "Published under CC-BY-4.0.": "CC-BY-4.0", "GNU GENERAL PUBLIC LICENSE\n   Version 2, June 1991": "GPL-2.0",
    "Words that run on\nLicensed under the Apache License,\nVersion 2.0\nand more": "Apache-2.0", "The rights of a license of mit.": "", "We are not licensed under the MIT License.": "",
    "SPDX-License-Identifier: MIT OR Apache-2.0": "Apache-2.0,MIT", "# SPDX-License-Identifier: (MIT AND BSD-2-Clause) OR ISC": "MIT,BSD-2-Clause,ISC", "SPDX-License-Identifier: ISC": "ISC",
    "SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0": "GPL-2.0", "Music or words\nSPDX-License-Identifier: MIT\nSalt and Apache-2.0 or more": "MIT",
    "Licensed under the MIT license and the Apache License, Version 2.0.": "Apache-2.0,MIT",
    "The library is licensed under the Apache License, Version 2.0 and the docs under CC BY 4.0.": "Apache-2.0,CC-BY-4.0",
    "You can redistribute it and/or modify it under the terms of the GNU General Public License.": "GPL", "Licensed under the GNU Lesser General Public License.": "LGPL", "License: AGPL": "AGPL",
    "Released under the zlib license.": "Zlib", "Distributed under the Boost Software License, Version 1.0.": "BSL-1.0", "License: EPL-1.0": "EPL-1.0", "Released under the Unlicense.": "Unlicense",
    "SPDX-License-Identifier: " + "MIT OR " * 20000 + "ISC": "MIT,ISC",
    "#" * 30000 + "\n" * 30000 + "licence (" * 3000: "",
}


def test_verbatim_notices(spark):
    rows = [(n, t) for n, (t, _) in NOTICES.items()] + [(f"{n} crlf", "Words before.\r\n\r\n" + t.replace("\n", "\r\n") + "\r\n\r\nWords after.") for n, (t, _) in NOTICES.items()]
    got = {i: (ids, names) for i, _, ids, names in scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    for name, (_, ids) in NOTICES.items():
        assert got[name][1] == got[f"{name} crlf"][1] == name, (name, got[name])
        assert got[name][0] == got[f"{name} crlf"][0] and (ids is None or got[name][0] == ids), (name, got[name])


def test_one_line_forms(spark):
    rows = list(LINES.items())
    got = scan(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")).collect()
    assert {rows[r.doc_id][0][:80]: r.licences for r in got} == {t[:80]: n for t, n in rows}
