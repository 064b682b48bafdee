import duckdb

from tessera.llm import license_rules as lr
from tessera.llm.common import table

SF = "/root/testdata/sf0.01"

MIT = """MIT License

Copyright (c) 2001 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,
modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice
shall be included in all copies or substantial portions of the Software. The rest."""


def test_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    want = con.execute(lr.oracle()).fetchall()
    got = [tuple(r) for r in lr.report(table(spark, SF, "documents")).collect()]
    assert sorted(got) == sorted(want)
    assert {r[5] for r in got} > {"", "MIT", "Apache-2.0", "CC-BY-NC-4.0", "GPL-3.0-only"}


def test_rules_and_small_cases(spark, make_docs):
    one_line = MIT.replace("\n\n", "@").replace("\n", " ").replace("@", "\n")
    rows = [(1, one_line), (2, None), (3, ""), (4, "All rights reserved. x. Released under the MIT License"),
            (5, "released under the mit LICENSE? Released under the MIT license!"), (6, ". . !"),
            (7, "text here. " * 20000 + "Licensed under CC BY 4.0."), (7, "nothing"), (None, "All Rights Reserved."),
            (8, "This program is free software: a. b. c. d. e. you can redistribute it")]
    got = {(r.doc_id, r.n_sentences, r.license_sequence, r.licenses) for r in lr.report(make_docs(rows)).collect()}
    assert got == {(1, 5, "MIT", "MIT"), (2, 0, "", ""), (3, 0, "", ""),
                   (4, 3, "LicenseRef-All-Rights-Reserved,MIT", "LicenseRef-All-Rights-Reserved,MIT"),
                   (5, 2, "MIT,MIT", "MIT"), (6, 0, "", ""), (7, 20001, "CC-BY-4.0", "CC-BY-4.0"), (7, 1, "", ""),
                   (None, 1, "LicenseRef-All-Rights-Reserved", "LicenseRef-All-Rights-Reserved"), (8, 7, "", "")}
    assert lr.report(make_docs([])).count() == 0


def test_gap_and_precedence(spark, make_docs):
    sentences, rules = {"a": "a", "b": "b"}, (("AB", ("a", "b")), ("B", ("b",)))
    rows = [(1, "a. x. b."), (2, "a. x. x. b."), (3, "b. a."), (4, "a. b. b."), (5, "a. a. b.")]
    got = {r.doc_id: r.license_sequence for r in lr.report(make_docs(rows), sentences=sentences, rules=rules,
                                                           max_gap=1).collect()}
    assert got == {1: "AB", 2: "B", 3: "B", 4: "AB,B", 5: "AB"}


def test_plan_is_native(spark):
    plan = lr.report(table(spark, SF, "documents"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version."""


def test_wrapped_notices(spark, make_docs):
    commented = lambda lead, text: "\n".join((lead + x).rstrip() for x in text.split("\n"))
    apache = 'Licensed under the Apache License,\nVersion 2.0 (the "License");\nyou may not use this file except in\n' \
             "compliance with the License.\n"
    rows = [(1, MIT), (2, commented("# ", MIT)), (3, commented(" * ", MIT.replace("\n", "\r\n"))), (4, commented("// ", GPL)),
            (5, "Copyright 2001 A\n" + apache + "x"), (6, "Released under\n\nthe MIT License."), (7, MIT.replace("free", "f")),
            (8, "Released\nunder\nthe\nMIT\nLicense\nand more"), (9, "Released under\nthe MIT License and more."),
            (10, "All rights reserved\nReleased under the MIT License"), (11, "released under the\n" * 500)]
    got = {r.doc_id: (r.license_sequence, r.sentence_ids) for r in lr.report(make_docs(rows)).collect()}
    mit = ("MIT", "mit-title,mit-grant,mit-notice")
    assert got == {1: mit, 2: mit, 3: mit, 4: ("GPL-3.0-or-later", "gpl-free,gpl3-terms"),
                   5: ("Apache-2.0", "apache-header,apache-comply"), 6: ("", "mit-title-long"), 7: ("", "mit-title,mit-notice"),
                   8: ("MIT", "mit-ref"), 9: ("", ""),
                   10: ("LicenseRef-All-Rights-Reserved,MIT", "all-rights,mit-ref"), 11: ("", "")}


BSD = """Copyright (c) 2001, Somebody
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED."""


def test_numbered_clauses(spark, make_docs):
    unwrapped = "\n".join(" ".join(x.split()) for x in BSD.split("\n\n"))
    two = BSD[:BSD.index("3. Neither")] + BSD[BSD.index("THIS"):]
    rows = [(1, BSD), (2, unwrapped), (4, two),
            (5, BSD.replace("1. ", "1. " + "Other. " * 3))]
    got = {r.doc_id: r.license_sequence.removeprefix("LicenseRef-All-Rights-Reserved,")
           for r in lr.report(make_docs(rows)).collect()}
    assert got == {1: "BSD-3-Clause", 2: "BSD-3-Clause", 4: "BSD-2-Clause", 5: "BSD-2-Clause"}


def test_wordings(spark, make_docs):
    lgpl = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version."""
    mpl = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""
    want = {"This work is licensed under CC BY 4.0.": "CC-BY-4.0", "Licensed under the MIT License.": "MIT",
            "Licensed under the GNU General Public License, version 3.": "GPL-3.0-only",
            "This file is\n# distributed under the terms of the\n# GNU GPL v2 or later.": "GPL-2.0-or-later",
            "Released under CC0 1.0 Universal": "CC0-1.0", lgpl: "LGPL-2.1-or-later", mpl: "MPL-2.0",
            GPL.replace("General", "Affero General"): "AGPL-3.0-or-later",
            GPL.replace("This program is free software: you", "You").replace("version 3", "version 2"): "GPL-2.0-or-later",
            "GNU GENERAL PUBLIC LICENSE\n  Version 2, June 1991": "GPL-2.0-only",
            "// SPDX-License-Identifier: Apache-2.0\nx": "Apache-2.0", "/* SPDX-License-Identifier: GPL-2.0+ */": "GPL-2.0-or-later",
            "# SPDX-License-Identifier: (MIT OR Apache-2.0)": "MIT OR Apache-2.0", "MIT": "", "SPDX-License-Identifier: Foo": "",
            "Licensed under protest.": "", "Work done under the MIT License": "", "under the mit license": "",
            "This work is licensed under the Eclipse Public License 2.0.": "EPL-2.0"}
    rows = list(enumerate(want))
    got = {rows[r.doc_id][1]: r.license_sequence for r in lr.report(make_docs(rows)).collect()}
    assert got == want
    every = lr._literals(lr.ALL_SENTENCES)
    assert len({s for s, _ in every}) == len(every) and all(" ".join(s.split()) == s == s.lower() for s, _ in every)
