"""The scanner names the right license: notices as projects write them, edited and not, against their true names."""

import random
import re

import pytest

from helixgrid.llm import licenses

GNU = "This {p} is free software{c} you can redistribute it and/or modify it under the terms of the GNU {n} as published by the Free Software Foundation{c} either version {v} of the License, or (at your option) any later version. This {p} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {n} for more details."
ONLY = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {n} version {v} as published by the Free Software Foundation. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {n} for more details."
NAMES = {"gpl": "General Public License", "lgpl": "Lesser General Public License", "agpl": "Affero General Public License"}
LONG = [(GNU.format(p=p, c=c, n=NAMES[k], v=v), f"{k}-{w}-header") for k, v, w in (("gpl", "2", "2.0"), ("gpl", "3", "3.0"), ("lgpl", "2.1", "2.1"), ("lgpl", "3", "3.0"), ("agpl", "3", "3.0")) for p, c in (("program", ":"), ("file", ";"))]
LONG += [(ONLY.format(n=NAMES[k], v=v), f"{k}-{w}-only-header") for k, v, w in (("gpl", "2", "2.0"), ("gpl", "3", "3.0"), ("lgpl", "2.1", "2.1"), ("agpl", "3", "3.0"))]
LONG += [
    (GNU.format(p="program", c=";", n="Library General Public License", v="2"), "lgpl-2.0-header"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "mpl-2.0-header"),
    ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/", "epl-2.0-header"),
    (licenses.TEMPLATES["apache-2.0-header"], "apache-2.0-header"),
    (licenses.TEMPLATES["mit"], "mit"),
    (licenses.TEMPLATES["isc"], "isc"),
    (licenses.TEMPLATES["bsd-2-clause"], "bsd-2-clause"),
    (licenses.TEMPLATES["bsd-3-clause"], "bsd-3-clause"),
    (licenses.TEMPLATES["zlib"], "zlib"),
]
SHORT = [(f"Licensed under CC {k} 4.0", f"cc-{k.lower()}-4.0-notice") for k in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND")]
SHORT += [(f"This work is licensed under a Creative Commons {n} 4.0 International License.", f"cc-{k}-4.0") for k, n in (("by", "Attribution"), ("by-sa", "Attribution-ShareAlike"), ("by-nc-nd", "Attribution-NonCommercial-NoDerivatives"))]
SHORT += [(f"SPDX-License-Identifier: {k}", f"spdx-{k}") for k in ("GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-or-later", "LGPL-2.1-or-later", "AGPL-3.0-only", "MPL-2.0", "EPL-2.0", "MIT", "MIT-0", "BSD-3-Clause", "CC-BY-SA-4.0", "GPL-2.0")]
SHORT += [("Released under the MIT License.", "mit-notice"), ("Licensed under the Apache License, Version 2.0.", "apache-2.0-notice"), ("This work is licensed under the GNU Lesser General Public License, version 2.1.", "lgpl-2.1-notice"), ("This work is licensed under the GNU General Public License, version 2.", "gpl-2.0-notice")]
#: Notices of licenses and versions that no template has.
NONE = ["Licensed under CC BY 3.0", "Licensed under the Apache License, Version 1.1.", "Released under the MIT style License.", GNU.format(p="program", c=";", n="General Public License", v="1"), "This work is licensed under the GNU General Public License, version 1."]


@pytest.fixture(scope="module")
def scanner():
    return licenses.Scanner(licenses.TEMPLATES, 0.75)


def names(scanner, text):
    (found,) = scanner.scan(["some words before " + text + " and words behind"])
    return [m[0] for m in found]


def test_true_names(scanner):
    assert len(LONG + SHORT) >= 40
    for text, name in LONG + SHORT:
        assert names(scanner, text) == [name], text
    for text in NONE:
        assert names(scanner, text) == [], text


def test_edited_notices_are_never_named_wrongly(scanner):
    """0 to 15 % of the words replaced, left out or followed by another one: right, or nothing where a deciding word went."""
    rng = random.Random(8)
    tried = right = 0
    for text, name in LONG:
        for share in (0.03, 0.07, 0.15):
            for _ in range(4):
                words = []
                for w in re.findall(r"\S+", text):
                    roll = rng.random()
                    words += [w] if roll >= share else rng.choice([["edited"], [], [w, "extra"]])
                got = names(scanner, " ".join(words))
                assert set(got) <= {name}, (name, share, got)
                tried, right = tried + 1, right + (got == [name])
    assert right >= 0.8 * tried, (right, tried)


def test_the_vote_loses_nothing(scanner, monkeypatch):
    monkeypatch.setattr(licenses, "VOTE", 0.0)
    every = licenses.Scanner(licenses.TEMPLATES, 0.75)
    rng = random.Random(9)
    for text, _ in LONG + SHORT:
        for share in (0.0, 0.1, 0.2):
            edited = " ".join(w if rng.random() >= share else "edited" for w in text.split())
            assert names(every, edited) == names(scanner, edited)


def test_coverage_both_ways(spark):
    text = LONG[0][0].replace("useful", "useful one two three four")
    (r,) = licenses.scan_licenses(spark.createDataFrame([(1, text, 0.5)], "doc_id long, text string, text_coverage double")).collect()
    assert r.coverage == 1.0 and 0.9 < r.text_coverage < 1.0
