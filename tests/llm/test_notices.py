"""Licence notices as projects write them, with the labels a reader gives them, and sentences that name licences without stating one."""

import itertools

import pytest

from tidegrid.llm.licenses import Scanner

#: (notice, labels)
NOTICES = [
    ("This project is licensed under the terms of the MIT license.", "mit"),
    ("MIT License\n\nCopyright (c) 2019 Jane Doe\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software", "mit"),
    ("MIT licensed", "mit"),
    ("Released under the MIT/X11 license.", "mit"),
    ("Distributed under the MIT (X11) licence", "mit"),
    ("Code is available under MIT.", "mit"),
    ("// Use of this source code is governed by an MIT-style\n// license. https://opensource.org/licenses/MIT", "mit"),
    ("See opensource.org/licenses/MIT for the text", "mit"),
    ("license: MIT", "mit"),
    ('  "license": "MIT",', "mit"),
    ("license = 'MIT'", "mit"),
    ("SPDX-License-Identifier: MIT", "mit"),
    ("/* SPDX-License-Identifier: MIT OR Apache-2.0 */", "apache-2.0,mit"),
    ("# SPDX-License-Identifier: (GPL-2.0-only OR BSD-2-Clause)", "bsd-2-clause,gpl-2.0"),
    ("SPDX-License-Identifier: GPL-2.0 WITH Linux-syscall-note", "gpl-2.0"),
    ("SPDX-License-Identifier: LGPL-2.1-or-later AND (MIT OR ISC)", "isc,lgpl-2.1,mit"),
    ("SPDX-License-Identifier: AGPL-3.0-or-later", "agpl-3.0"),
    ("SPDX-License-Identifier: 0BSD", "0bsd"),
    ("license: Apache-2.0 OR MIT", "apache-2.0,mit"),
    ('license = "MIT/Apache-2.0"', "apache-2.0,mit"),
    ('license = "(MIT OR Unlicense)"', "mit,unlicense"),
    ('"licenses": ["ISC"]', "isc"),
    ('Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.', "apache-2.0"),
    ("Licensed under Apache 2.0", "apache-2.0"),
    ("Apache-2.0 licensed", "apache-2.0"),
    ("Apache 2.0 License", "apache-2.0"),
    ("You may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0", "apache-2.0"),
    ("See the License for the specific language governing permissions and\n limitations under the License.", "apache-2.0"),
    ("Licensed under GPLv3.", "gpl-3.0"),
    ("License: GPL v3", "gpl-3.0"),
    ("License: GPLv3+", "gpl-3.0"),
    ("This is GPL-3.0-or-later code", "gpl-3.0"),
    ("LGPLv2.1", "lgpl-2.1"),
    ("AGPLv3", "agpl-3.0"),
    ("distributed under the GNU GPL", "gpl"),
    ("License: LGPL", "lgpl"),
    ("released under GPL version 2", "gpl-2.0"),
    ("GPL, version 2", "gpl-2.0"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License", "gpl,gpl-3.0"),
    ("This library is licensed under the GNU Lesser General Public License version 2.1", "gpl,lgpl-2.1"),
    ("GNU Affero General Public License v3.0", "agpl-3.0,gpl"),
    ("https://www.gnu.org/licenses/gpl-3.0.html", "gpl-3.0"),
    ("GNU Free Documentation License, Version 1.3", "gfdl-1.3"),
    ("under the terms of the GNU Free Documentation License", "gfdl"),
    ('BSD 3-Clause "New" or "Revised" License', "bsd-3-clause"),
    ("BSD 3-Clause License\n\nCopyright (c) 2020, ACME\nAll rights reserved.", "bsd-3-clause"),
    ("3-Clause BSD License", "bsd-3-clause"),
    ("Licensed under the new BSD license", "bsd-3-clause"),
    ('BSD 2-Clause "Simplified" License', "bsd-2-clause"),
    ("Two-clause BSD", "bsd-2-clause"),
    ("License: BSD", "bsd"),
    ("a BSD-style license that can be found in the LICENSE file", "bsd"),
    ("Copyright (c) 1994\nThe Regents. All rights reserved.\n\nRedistribution and use in source and binary forms, with or without modification", "bsd"),
    ("Neither the name of ACME nor the names of its contributors may be used to endorse or promote products", "bsd-3-clause"),
    ("ISC License", "isc"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee", "isc"),
    ("This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0.", "mpl-2.0"),
    ("MPL-2.0", "mpl-2.0"),
    ("licensed under MPLv2", "mpl-2.0"),
    ("Mozilla Public License Version 1.1", "mpl-1.1"),
    ("Eclipse Public License - v 1.0", "epl-1.0"),
    ("Eclipse Public License 2.0", "epl-2.0"),
    ("made available under the Common Public License v1.0", "cpl-1.0"),
    ("Common Public License", "cpl"),
    ("European Union Public Licence v. 1.2", "eupl-1.2"),
    ("Open Software License version 3.0", "osl-3.0"),
    ("Business Source License 1.1", "busl-1.1"),
    ("licensed under the Elastic License 2.0", "elastic-2.0"),
    ("licensed under the Elastic License", "elastic"),
    ("Server Side Public License", "sspl-1.0"),
    ("Distributed under the Boost Software License, Version 1.0.", "bsl-1.0"),
    ("This is free and unencumbered software released into the public domain.", "public-domain,unlicense"),
    ("Creative Commons Attribution 4.0", "cc-by-4.0"),
    ("https://creativecommons.org/licenses/by-sa/4.0/", "cc-by-sa-4.0"),
    ("CC BY-NC-SA 4.0", "cc-by-nc-sa-4.0"),
    ("creativecommons.org/publicdomain/zero/1.0", "cc0-1.0"),
    ("License: CC0", "cc0-1.0"),
    ("Python Software Foundation License", "psf-2.0"),
    ("zlib/libpng License", "zlib"),
    ("Microsoft Public License", "ms-pl"),
    ("SIL Open Font License", "ofl-1.1"),
    ("Copyright 2021 ACME. All rights reserved.", "proprietary"),
    ("Proprietary and confidential", "proprietary"),
]

#: Sentences that state no license.
OTHERS = [
    "", "the elastic license plate", "MIT researchers found it", "we studied at MIT and Harvard", "an Apache helicopter 2 miles off", "Apache 2.4 serves the site", "the Apache web server",
    "she got her driver's license: finally", "a licensed plumber", "the mitre box", "limit: 20", "public opinion", "the general public was not admitted", "affero is no word",
    "he published under the name of Boost", "free documentation is good", "common public goods", "the open software movement", "business source data", "postgresql is a database",
    "openssl s_client -connect host:443", "import zlib", "zlib compression", "the isc west trade fair", "eclipse 2.0 of the sun", "mozilla firefox 2.0", "an artistic director",
    "python software", "a creative common room", "unlicensed taxi", "gplus", "lgp 2", "cc: by mail", "rights are reserved for members", "apachecon 2", "license to kill", "license and registration",
    "permission is granted to enter", "redistribution of wealth", "a summit licence", "submit license forms", "version 2.0", "spdx tools", "an expatriate license fee", "bsd is an operating system",
]

CASES = [str.upper, str.lower, lambda t: t.replace(" ", "  "), lambda t: t.replace(" ", "\n"), lambda t: f"Foo bar baz.\n\n{t}\n\nMore words follow here."]


@pytest.fixture(scope="module")
def scanner():
    return Scanner()


def test_labels_of_notices(scanner):
    """Every notice as written and in five other settings; labels that are more general than one asked for are no error where they are the base's."""
    right = wanted = given = 0
    wrong = []
    for (notice, labels), change in itertools.product(NOTICES, [str, *CASES]):
        want, got = set(labels.split(",")), scanner.scan(change(notice))[3]
        right, wanted, given = right + len(want & got), wanted + len(want), given + len(got)
        if want != got:
            wrong.append((change(notice)[:60], sorted(want), sorted(got)))
    assert right / wanted >= 0.97 and right / given >= 0.97, (right, wanted, given, wrong[:20])


def test_other_sentences_have_no_label(scanner):
    told = [(t, scanner.scan(change(t))[3]) for t, change in itertools.product(OTHERS, [str, *CASES])]
    assert [x for x in told if x[1]] == []


def test_gate_loses_nothing(scanner):
    """With every keyword taken as found, the same detections."""
    from tidegrid.llm.licenses import Spaced

    for (notice, _), change in itertools.product(NOTICES, [str, *CASES]):
        flat = Spaced(change(notice).lower())
        found = {key for _, key in scanner.keys.iter(flat.text)}
        assert scanner.detections(flat, found) == scanner.detections(flat, set(scanner.of_key))


def test_long_expressions_take_linear_time(scanner):
    import time

    for text in ("license: " + "a or " * 100_000, "license: " + "(" * 200_000, "spdx-license-identifier: " + "mit or " * 50_000, "gpl " * 100_000 + "license: " * 50_000):
        start = time.perf_counter()
        scanner.scan(text)
        assert time.perf_counter() - start < 5, text[:30]
