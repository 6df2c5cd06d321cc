from loresift.llm.licenses import scan

APACHE = "Licensed under the Apache License, Version 2.0."
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""


def test_scan(spark):
    rows = [
        (1, f"Some text here.\n{APACHE}\nMore.", ""), (2, MIT, ""), (3, "The license is nice. Apache helicopters.", ""), (4, None, ""), (5, "", ""),
        (6, "no end before\nReleased under the MIT License.\nLicensed under CC BY-NC 4.0.", ""), (None, APACHE, ""), (7, "x. " * 50_000 + APACHE, ""),
        (8, "\n\n".join(reversed(MIT.split("\n\n"))), ""),
    ]
    got = {r.doc_id: (r.licences, r.n_licences) for r in scan(spark.createDataFrame(rows, "doc_id long, text string, licences string")).collect()}
    assert got == {
        1: ("Apache-2.0", 1), 2: ("MIT", 1), 3: ("", 0), 4: ("", 0), 5: ("", 0), 6: ("CC-BY-NC-4.0,MIT", 2), None: ("Apache-2.0", 1), 7: ("Apache-2.0", 1), 8: ("", 0),
    }
    assert scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_forms_of_a_licence(spark):
    """Written by hand, not from the rule book."""
    expected = {
        "// SPDX-License-Identifier: Apache-2.0\nint main() {}": "Apache-2.0",
        "# SPDX-License-Identifier: GPL-3.0-or-later": "GPL-3.0",
        "Er kam mit.\nNothing else.": "",
        "The parser, written in 2019 by A. Person, is licensed under the MIT License.": "MIT",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.": "CC-BY-4.0",
        "It was released under the MIT license; parts are licensed under the GNU Lesser General Public License, version 3.": "LGPL-3.0,MIT",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.": "CC0-1.0",
        "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n\n2. Grant of Copyright License.\n\n3. Grant of Patent License.": "Apache-2.0",
        "Grant of Patent License. Grant of Copyright License.": "",
        "All rights reserved.": "all-rights-reserved",
    }
    rows = [(i, t) for i, t in enumerate(expected)] * 2
    got = scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 2 * len(expected) and {(r.doc_id, r.licences) for r in got} == set(enumerate(expected.values()))
