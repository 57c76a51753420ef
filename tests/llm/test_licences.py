"""Notices with holders, years, other sentences and wrapping."""

import math
import random
import re
import textwrap
from collections import Counter

from tracelake.llm import licences

PROSE = "The river ran past the old mill and nobody spoke for a while. "


def test_notices_with_names_years_and_wrapping(spark):
    texts = [
        ("Apache-2.0", "Copyright (c) 2024 Jane Doe. Licensed under the Apache License, Version 2.0."),
        ("Proprietary", "Copyright 2023 Acme Corp. All rights reserved."),
        ("MIT", "Released by Jane Doe in 2024 under the MIT License."),
        ("GPL-3.0", "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation."),
        ("CC-BY-4.0", PROSE * 5 + "This text is licensed under CC BY 4.0. " + PROSE * 5),
        (None, PROSE * 3 + "Her driving license was in the drawer. " + PROSE),
        ("CC-BY-NC-4.0", "Told by Jane Doe and by others.\nPictures licensed by Jane under CC BY-NC 4.0.\nRead by all."),
        (None, "The public domain is wide."),
    ]
    df = spark.createDataFrame([(i, f"d{i}/x.txt", t) for i, (_, t) in enumerate(texts)] + [(50, "d4/y.txt", "nothing")], "doc_id long, path string, text string")
    got = {r.doc_id: r.licence for r in licences.scan(df, licences.templates(spark)).collect()}
    assert got == {i: want for i, (want, _) in enumerate(texts)} | {50: None}


def terms(text):
    return re.findall(r"[^\W_]+(?:[.+-][^\W_]+)*", re.sub(r"\bcc by\b", "cc-by", text.lower()))


def truth(files, notices):
    """Every line, every window and every whole file against every template, then every ancestor of every file."""
    df = Counter(t for _, _, text in files for t in set(terms(text or "")))
    idf = lambda t: math.log(1 + len(files) / df[t]) if df[t] else math.log(1 + len(files))
    vector = lambda text: {t: (1 + math.log(n)) * idf(t) for t, n in Counter(terms(text)).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    known = [(name, vector(text), i >= len(licences.NOTICES)) for i, (name, text) in enumerate(notices)]
    says_no = lambda words: bool(set(words) & set(licences.NEGATIONS))

    def stands(t, words, no):
        return (not no or says_no(t)) and (len(t) > licences.SHORT or "copyright" in words or len(set(words)) <= len(t) + licences.OTHERS)
    own, spoken = {}, {}
    for i, path, text in files:
        lines, found, is_file = (text or "").split("\n"), [], False
        for name, t, is_text in known:
            weight = -round(norm(t), 6)
            for k, unit in [(0, text or ""), *((1, x) for x in lines)]:
                v = vector(unit)
                score = sum(x * t.get(w, 0) for w, x in v.items()) / (norm(v) * norm(t)) if v else 0
                if score >= licences.LEAST_COSINE and (stands(t, v, says_no(v)) or k == 0 and is_text):
                    found.append((-round(score, 9), weight, k, name))
                    is_file |= k == 0 and (is_text or round(score, 9) >= licences.NOTHING_ELSE)
            windows = [(lines[max(0, n - 1) : n + 3], lines[max(0, n - 1) : n + 2]) for n in range(len(lines))]
            for block, near in [*windows, (lines[: licences.HEAD], lines[: licences.HEAD])]:
                here = set(terms(" ".join(block)))
                score = sum(x * x for w, x in t.items() if w in here) / norm(t) ** 2
                if score >= licences.LEAST_HELD and stands(t, here, says_no(terms(" ".join(near)))):
                    found.append((-round(score, 9), weight, 2, name))
        if found:
            own[i] = min(found)[3]
            if path and (is_file or re.search(licences.FILE_NAME, path)):
                at = path.rpartition("/")[0]
                spoken[at] = min(spoken.get(at, (1,)), (min(found)[0], path, own[i]))
    out = {}
    for i, path, _ in files:
        out[i] = (own.get(i), "own" if i in own else None)
        if path and i not in own:
            parts = path.split("/")
            for n in range(len(parts) - 1, -1, -1):
                if "/".join(parts[:n]) in spoken:
                    out[i] = (spoken["/".join(parts[:n])][2], "inherited")
                    break
    return out


def test_scan_equals_brute_force(spark):
    rnd = random.Random(2)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7))) for _ in range(400)] + ["the", "of", "license", "under", "rights", "public", "work"]
    prose = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    wrap = lambda text, n: "\n".join(text[i : i + n] for i in range(0, len(text), n))
    files = []
    for i in range(120):
        notice = rnd.choice(licences.TEMPLATES)[1]
        if rnd.random() < 0.3:
            notice = notice.replace(" ", "\n", 3)
        kinds = [prose(60), prose(20) + "\n" + notice, prose(6) + " " + notice + " " + prose(4) + "\n" + prose(30), notice, "# " + notice + "\n" + prose(200), "", None]
        path = "/".join([*rnd.choices("abc", k=rnd.randint(0, 3)), rnd.choice(["LICENSE", "x.py", "y.md", f"f{i}"])])
        files.append((i, path if i % 17 else None, rnd.choice(kinds)))
    df = spark.createDataFrame(files, "doc_id long, path string, text string")
    got = {r.doc_id: (r.licence, r.how) for r in licences.scan(df, licences.templates(spark)).collect()}
    assert got == truth(files, licences.TEMPLATES) and len({x for x, _ in got.values()}) > 8


def test_wrapped_licence_files_are_recognised(spark):
    by_size = sorted(licences.TEMPLATES, key=lambda t: -len(t[1]))
    files = [(name, "Copyright (c) 2021 Some Body and others\n\n" + textwrap.fill(text, 68)) for name, text in by_size[:2]]
    files += [("Apache-2.0", "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n\n   1. Definitions.")]
    files += [("GPL-3.0", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>\n Everyone is permitted to copy and distribute verbatim copies\n of this license document, but changing it is not allowed.")]
    rows = [(i, f"p{i}/LICENSE", t) for i, (_, t) in enumerate(files)] + [(10 + i, f"p{i}/src/main.py", "print()") for i in range(len(files))]
    rows += [(100 + i, f"other/{i}", PROSE * 4) for i in range(40)]
    got = {r.doc_id: r.licence for r in licences.scan(spark.createDataFrame(rows, "doc_id long, path string, text string"), licences.templates(spark)).collect()}
    assert all(got[i] == got[10 + i] == name for i, (name, _) in enumerate(files)) and not any(got[100 + i] for i in range(40))


LGPL = "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.\n"
ISC = "ISC License\n\nCopyright (c) 2019, A. Person\n\n" + textwrap.fill(licences.TEXTS[[n for n, _ in licences.TEXTS].index("ISC")][1], 72)


def test_near_relatives_and_prose(spark):
    header = lambda what, kind, v, n: "\n".join("# " + x for x in textwrap.fill(f"Copyright 2020 A. Person. This {what} is free software; you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by the Free Software Foundation; either version {v} of the License, or (at your option) any later version.", n).split("\n"))
    texts = [("LGPL-2.1", LGPL), ("LGPL-2.1", LGPL + "\n" + PROSE * 30), ("ISC", ISC)]
    texts += [(name, header(what, kind, v, n) + "\n\nimport x\n" + PROSE * 9) for n in (40, 60, 79) for name, what, kind, v in (("GPL-2.0", "program", "", "2"), ("GPL-3.0", "program", "", "3"), ("LGPL-2.1", "library", "Lesser ", "2.1"), ("LGPL-3.0", "library", "Lesser ", "3"), ("AGPL-3.0", "program", "Affero ", "3"))]
    texts += [(name, f"// SPDX-License-Identifier: {spdx}\n{PROSE}") for name, spdx in (("MIT", "MIT"), ("GPL-2.0", "GPL-2.0-only"), ("LGPL-3.0", "LGPL-3.0-or-later"), ("ISC", "ISC"), ("MPL-2.0", "MPL-2.0"))]
    prose = ["All rights reserved for the band", "Of these many were not released under the MIT license.", "It was never licensed under the Apache License, Version 2.0.", "They had all rights reserved in their hearts, and the seats as well.", PROSE + "The songs were\nnot released under the MIT License."]
    rows = [(i, f"p{i}/LICENSE" if name == "ISC" and "Copyright" in t else f"p{i}/x.py", t) for i, (name, t) in enumerate(texts)] + [(100 + i, f"q{i}/x.txt", t) for i, t in enumerate(prose)]
    rows += [(200, "p2/src/y.py", "print()"), (201, "p1/y.py", "print()")] + [(300 + i, f"r/{i}", PROSE * 3 + f"word{i}") for i in range(60)]
    got = {r.doc_id: (r.licence, r.how) for r in licences.scan(spark.createDataFrame(rows, "doc_id long, path string, text string"), licences.templates(spark)).collect()}
    wrong = [(t[:60], got[i], name) for i, (name, t) in enumerate(texts) if got[i] != (name, "own")] + [(t, got[100 + i]) for i, t in enumerate(prose) if got[100 + i] != (None, None)]
    assert not wrong
    assert got[200] == ("ISC", "inherited") and got[201] == (None, None)  # a header speaks for its file only


def test_defined_cases(spark):
    mit = "Released under the MIT License."
    rows = [(1, "a/x", mit, "c"), (1, "a/x", mit, "c"), (1, "a/y", PROSE, "c"), (2, "b/z", PROSE * 20_000 + "\n" + mit, "c"), (3, "b/w", "", "c"), (None, "b/v", mit, "c")]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string, licence string")
    got = Counter((r.doc_id, r.path, r.licence, r.how) for r in licences.scan(df, licences.templates(spark)).collect())
    assert got == Counter({(1, "a/x", "MIT", "own"): 2, (1, "a/y", "MIT", "inherited"): 1, (2, "b/z", "MIT", "own"): 1, (3, "b/w", None, None): 1, (None, "b/v", None, None): 1})
    none = licences.scan(df, licences.templates(spark).limit(0)).collect()
    assert len(none) == 6 and not any(r.licence for r in none)
