import re
import textwrap

import pytest

from kindredge.llm import licenses as L


def brute(rows):
    """A slow reading: pieces between ends, every run of pieces that crosses ends of lines only, longest sentence first."""
    number = {}
    for i, s in enumerate(L.SENTENCES.values()):
        number[L.normal(s)] = i
    out = []
    for doc, text in rows:
        t = (text or "").translate(str.maketrans(L._UPPER, L._LOWERED))
        marked, places = [], re.split("([^a-z0-9]+)", t)
        for i, part in enumerate(places):
            if i % 2 == 0:
                marked.append(part)
            elif re.search("[.;!?][ \\t\\r\\n]", part) or re.search("\\n[ \\t\\r]*\\n", part):
                marked.append("|")
            else:
                marked.append("~" if "\n" in part else " ")
        words = [w for w in marked[0::2]]
        seps = ["|", *marked[1::2], "|"]
        if words and not words[0]:
            words, seps = words[1:], ["|", *seps[2:]]
        if words and not words[-1]:
            words, seps = words[:-1], [*seps[:-2], "|"]
        ids, i = [], 0
        while i < len(words):
            best = None
            if seps[i] != " ":
                for j in range(i, min(len(words), i + 120)):
                    if seps[j + 1] != " " and " ".join(words[i:j + 1]) in number:
                        best = j
                    if seps[j + 1] == "|":
                        break
            if best is None:
                i += 1
            else:
                ids.append(number[" ".join(words[i:best + 1])])
                i = best + 1
        for rule, (lic, names) in L.RULES.items():
            want, at, hits = [number[L.normal(L.SENTENCES[x])] for x in names], 0, []
            while at + len(want) <= len(ids):
                if ids[at:at + len(want)] == want:
                    hits.append(at)
                    at += len(want)
                else:
                    at += 1
            if hits:
                out.append((doc, rule, lic, len(hits), hits[0]))
    return sorted(out, key=str)


def scan(spark, rows):
    got = L.license_scan(spark.createDataFrame([(*x, "n", 1) for x in rows], "doc_id long, text string, license string, met int"))
    return sorted((tuple(x) for x in got.collect()), key=str)


def full(*names):
    return ".\n\n".join(L.SENTENCES[x] for x in names) + ".\n"


MIT = full("mit-title-2", "mit-grant", "mit-condition", "mit-warranty", "mit-liability")


def test_rules(spark):
    s = L.SENTENCES
    rows = [(1, "Some text. Released under the MIT License. More! Released under the  mit-license.\nEnd"), (2, MIT), (3, MIT + "\n" + MIT + "\n" + s["apache-notice"] + "."), (4, f"{s['gpl-free']}.\n{s['gpl-details']}."),
            (5, f"{s['gpl-free']}; {s['gpl-hope']}. noise noise. {s['gpl-details']}"), (6, None), (7, ""), (8, "the license of nothing"), (None, "Licensed under CC BY-NC 4.0."), (9, "x. " * 50000 + "All rights reserved."), (9, "x. " * 50000 + "All rights reserved."),
            (10, "-\n" * 40000 + "MIT License"), (11, "we are not Licensed under CC BY 4.0 at all"), (12, " |~All rights reserved~|"), (13, "Licensed under the\nMIT License\nAll rights\n\nreserved"), (14, "MIT License\nMIT License (MIT)\nThe MIT License (MIT)\n" + s["mit-grant"])]
    got = scan(spark, rows)
    assert got == brute(rows) and {x[0] for x in got} >= {1, 2, 3, 5, None, 9, 12, 13, 14}
    assert L.license_scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("width", [30, 60, 78, 100])
def test_wrapped_texts_are_found(spark, width):
    texts = {"mit-text": MIT, "bsd-3-text": full("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-name"), "bsd-2-text": full("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-warranty"),
             "apache-header": "Copyright 2020 A. Person\n\n" + L.SENTENCES["apache-notice-the"] + ";\n" + L.SENTENCES["apache-may-not"] + ".\n" + L.SENTENCES["apache-obtain"] + "\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\n" + L.SENTENCES["apache-unless"] + ".",
             "gpl3-header": full("gpl-free", "gpl-hope", "gpl-details"), "gpl2-header": "This program is free software; " + full("gpl2-under", "gpl2-version").replace(".\n\n", "; "), "mpl-header": "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at\nhttps://mozilla.org/MPL/2.0/."}
    wrap = lambda t: "\n\n".join(textwrap.fill(p, width) if "\n    " not in p else p for p in t.split("\n\n"))
    rows = [(i, wrap(t) if n not in ("apache-header", "mpl-header") else "\n".join(textwrap.fill(x, width) for x in t.split("\n"))) for i, (n, t) in enumerate(texts.items())]
    got = scan(spark, rows)
    assert got == brute(rows)
    for i, name in enumerate(texts):
        assert name in {x[1] for x in got if x[0] == i}, name


def test_faulty_rules_are_refused(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    with pytest.raises(ValueError):
        L.license_scan(docs, {"a": "!?"}, {})
    with pytest.raises(ValueError):
        L.license_scan(docs, {"a": "some words"}, {"r": ("X", ["b"])})


def test_anchors_cover():
    words = L.anchors(L.SENTENCES)
    assert all(any(w in L.normal(s).split() for w in words) for s in L.SENTENCES.values()) and len(words) < 12
