"""Chat collapse, sharding and the license scan against plain Python."""

import hashlib
import math
import random
import re
import zlib

import pytest
import regex

from millrace.llm import chat_collapse, licenses, queries, sharding

TURNS = "conv_id long, turn long, role string, text string, n long, label string"


def conversations(rng, n):
    rows = []
    for c in range(n):
        base = rng.randrange(6)
        turns = [("user" if i % 2 == 0 else "assistant", f"b{base} t{i}" if i < 5 else f"c{rng.randrange(3)}") for i in range(rng.randrange(1, 9))]
        rows += [(c, 2 * i, r, t, 5, "x") for i, (r, t) in enumerate(turns)]
    rows += [(None, 0, "user", "b0 t0", 5, "x"), (None, 1, None, None, 5, "x")]
    rows += [(500, 0, "user", "same", 5, "x")] * 3 + [(501, 0, "user", "same", 5, "x")] * 2 + [(502, 0, "user", None, 5, "x"), (503, 0, "user", "", 5, "x"), (504, None, "user", "z", 5, "x")]
    rows += [(505, 0, "user", "long " * 9000, 5, "x")]
    return rows


def collapsed(rows):
    convs = {}
    for c, t, r, x, *_ in rows:
        convs.setdefault(c, []).append((t, r, x))
    first = lambda v: (v is not None, v if v is not None else "")
    listed = {c: [(r, x) for _, r, x in sorted(l, key=lambda s: ((s[0] is not None, s[0] or 0), first(s[1]), first(s[2])))] for c, l in convs.items()}
    out = {}
    for c, l in listed.items():
        longer = any(len(o) > len(l) and o[: len(l)] == l for o in listed.values())
        least = min((d for d, o in listed.items() if o == l), key=lambda d: (d is not None, d or 0))
        if not longer and least == c:
            out[c] = (len(l), "".join(f"<|{r if r is not None else 'unknown'}|>\n{x or ''}\n<|end|>\n" for r, x in l))
    return out


@pytest.mark.parametrize("block", [2, 256])
def test_collapse(spark, monkeypatch, block):
    monkeypatch.setattr(chat_collapse, "BLOCK", block)
    rows = conversations(random.Random(block), 80)
    got = {}
    for r in sorted(chat_collapse.render(chat_collapse.collapse(spark.createDataFrame(rows, TURNS).repartition(5))).collect(), key=lambda r: r["part"]):
        n, text = got.get(r["conv_id"], (r["n_turns"], ""))
        got[r["conv_id"]] = (n, text + r["rendered"])
    assert got == collapsed(rows)


def test_no_conversations(spark):
    none = spark.createDataFrame([], TURNS)
    assert chat_collapse.render(chat_collapse.collapse(none)).collect() == []


def shard_of(key, weights):
    def bid(i):
        u = (int(hashlib.md5(f"{key}:{i}".encode()).hexdigest()[:12], 16) + 0.5) / 2.0**48
        return -math.log(u) / weights[i], i

    return min(map(bid, range(len(weights))))[1]


def test_sharding(spark, odd, none):
    weights, grown = [1.0, 2.0, 0.5], [1.0, 2.0, 0.5, 3.0]
    data = odd.select("doc_id", "text", "label").unionAll(spark.range(5000).selectExpr("id + 100", "repeat('é', cast(id % 7 AS int))", "''"))
    for block in (50, 20_000):
        got = sharding.shard_records(data, "doc_id", "text", weights, grown=grown, rows_per_block=block).collect()
        want = []
        for r in data.collect():
            key, raw = "null" if r["doc_id"] is None else r["doc_id"], (r["text"] or "").encode()
            want.append((r["doc_id"], len(raw) + 8, zlib.crc32(raw), shard_of(key, weights), shard_of(key, grown)))
        assert sorted(((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["grown_shard"]) for r in got), key=str) == sorted(want, key=str)
        for shard in range(3):
            slots = sorted(r["slot"] for r in got if r["shard"] == shard)
            assert slots == list(range(len(slots)))
        assert all(r["grown_shard"] in (r["shard"], 3) for r in got)
        assert abs(sum(r["shard"] == 1 for r in got) / len(got) - 2 / 3.5) < 0.03
    assert sharding.shard_records(none, "doc_id", "text", weights, grown=grown).collect() == []
    assert sharding.shard_records(odd, "doc_id", "text", weights).where("grown_shard IS NOT NULL").count() == 0


LICENSE_TEXTS = [
    None, "", "no such words here at all", "MIT License", "The MIT-License, and CC BY and cc-by 4.0", "cc by cc by; CC BY-SA 4.0",
    "This is licensed under the GNU General Public License, version 3.0 or any later version.", "gnu general public license gnu general public licenses",
    "Apache License 2.0", "Apache License, Version 2.0 (the licence)", "SPDX-License-Identifier: BSD-3-Clause", "SPDX-License-Identifier: GPL-2.0",
    "Permission is hereby granted, free of charge, to any person obtaining a copy", "All rights reserved. Copyright 2021 someone",
    "SPDX-License-Identifier: GPL-2.0-or-later", "SPDX-License-Identifier: (MIT OR Apache-2.0) AND LGPL-2.1-only", "Apache-2.0 OR MIT", "dual licensed under GPL v2 and MIT",
    "SPDX GPL-2.0-or-later", "SPDX-License-Identifier: Apache-2.0 WITH LLVM-exception", "not licensed under GPL but under the MIT license", "MulanPSL-1.0", "Copyright (c) 2020, © 2021",
    "It was never released under the Apache License 2.0.", "incompatible with the GNU GPL", "Copyleft; all rights reserved. For non-commercial use only.", "new BSD, 3-clause BSD and BSD 2 clause",
    "either version 2 of the License, or (at your option) any later version", "in the public domain; released into the public domain", "an open RAIL-M model; bigscience openrail",
    "ünder the mit license", "xmit license", "mit licenseé", "word " * 20_000 + "mit license", "(c) 2-clause BSD licensed; GNU Lesser General Public License v2.1",
]


def scanned(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    places, base = [], set()
    for phrase, label in licenses.BASE:
        p = phrase.split()
        for i in range(len(ws) - len(p) + 1):
            if ws[i : i + len(p)] == p:
                places.append(i)
                base.add(label)
    norm, found = " " + "".join(w + " " for w in ws), []
    for r in licenses.rules():  # all of them: nothing is gated here
        for hit in regex.finditer(r["regex"], norm):
            assert " " + r["keyword"] in norm, r
            a = norm.count(" ", 0, hit.start()) - 1
            found.append((a, -(a + hit.group().count(" ")), r["priority"], r["rule"], r["label"], r["confidence"]))
    kept = []
    for d in sorted(found):
        if not any(e[0] <= d[0] and e[1] <= d[1] and e[2] <= d[2] for e in kept):
            kept.append(d)
    labels = base | {d[4] for d in kept if d[4]}
    score = max([d[5] for d in kept if d[4]] + [0.7 if base else 0.0])
    return len(ws), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score


def test_licenses(spark, odd, none):
    rows = [(i, t, "s") for i, t in enumerate(LICENSE_TEXTS)] + [(None, "MIT License", "s"), (3, "MIT License", "s")]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, score string")).collect()
    want = sorted(((i, *scanned(t)) for i, t, _ in rows), key=str)
    assert sorted(map(tuple, got), key=str) == want
    assert licenses.scan(odd).count() == odd.count() and licenses.scan(none).collect() == []


def test_no_rule_is_gated_out(spark):
    """Texts that a rule matches although they hold none of the usual license words; every match of a rule holds its keyword."""
    texts = {
        "available under the GPL v3": "gpl-3.0", "released under the BSD 3-clause": "bsd-3-clause", "GNU LGPL 2.1": "lgpl-2.1", "use AGPL v3": "agpl-3.0", "the MPL 2.0": "mpl-2.0",
        "EUPL 1.2": "eupl-1.2", "0BSD": "0bsd", "do it as WTFPL says": "wtfpl", "CeCILL 2.1": "cecill-2.1", "Mulan PSL v2": "mulanpsl-2.0", "BigScience OpenRAIL-M": "rail", "an open rail": "rail",
        "Redistribution and use in source and binary forms, with or without modification, are permitted": "bsd", "proprietary and confidential": "proprietary",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted": "isc",
        "GNU Library General Public License 2.1": "lgpl-2.1", "the Expat licence": "mit", "Creative Commons Zero": "cc0", "subject to the licence": "unknown-license",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License": "gpl",
    }
    got = {r["text"]: r for r in licenses.scan(spark.createDataFrame([(t, t) for t in texts], "text string, body string"), id_col="text", text_col="body").collect()}
    assert {t: label for t, label in texts.items() if label not in got[t]["labels"].split(",") or not got[t]["score"]} == {}
    rng = random.Random(6)
    for r in licenses.rules():
        for _ in range(20):
            text = f" {sampled(re._parser.parse(r['regex']), rng)} "
            assert regex.search(r["regex"], text) is None or " " + r["keyword"] in text, (r, text)


def sampled(parsed, rng):
    """A text for a parsed regex, any of its branches taken."""
    out = ""
    for op, arg in parsed:
        op = str(op)
        if op == "BRANCH":
            out += sampled(rng.choice(arg[1]), rng)
        elif op == "SUBPATTERN":
            out += sampled(arg[3], rng)
        elif op == "MAX_REPEAT":
            out += "".join(sampled(arg[2], rng) for _ in range(rng.choice([arg[0], max(1, arg[0])])))
        elif op == "IN":
            kind, a = rng.choice(arg)
            out += chr(a if str(kind) == "LITERAL" else a[0])
        elif op == "LITERAL":
            out += chr(arg)
    return out


@pytest.mark.parametrize(
    "text, labels",
    [
        ("SPDX-License-Identifier: GPL-2.0-or-later", "gpl-2.0-or-later"), ("SPDX GPL-2.0-or-later", "gpl-2.0-or-later"), ("SPDX-License-Identifier: LGPL-2.1-only", "lgpl-2.1-only"),
        ("Apache-2.0 OR MIT", "apache-2.0,mit"), ("SPDX-License-Identifier: MIT OR Apache-2.0", "apache-2.0,mit"), ("not licensed under GPL", ""), ("MulanPSL-1.0", "mulanpsl-1.0"),
        ("SPDX-License-Identifier: Apache-2.0 WITH LLVM-exception", "apache-2.0,llvm-exception"), ("not licensed under the GPL but under the MIT license", "mit"),
        ("gplv3", "gpl-3.0"), ("GPLv2+", "gpl-2.0"), ("under GPLv2 or later.", "gpl-2.0-or-later"), ("LGPLv2.1", "lgpl-2.1"), ("AGPLv3", "agpl-3.0"), ("This MIT license is not GPL", "mit"),
        ("is neither GPL nor MIT licensed", ""), ("It is not under the GPLv3 licence, it is under the Apache License", "apache"),
    ],
)
def test_expressions_and_denials(spark, text, labels):
    assert scanned(text)[5] == labels
    assert licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["labels"] == labels


def test_rules_are_many_and_ordered(spark):
    rules = licenses.rules()
    for r in rules:
        spark._jvm.java.util.regex.Pattern.compile(r["regex"])
    assert len(rules) > 200 and [r["priority"] for r in rules] == sorted(r["priority"] for r in rules)
    assert all(regex.compile(r["regex"]) and r["keyword"] for r in rules) and len(licenses.TEXTS) == len({t[2] for t in licenses.TEXTS}) > 150


def test_native_queries_use_no_python(spark):
    for name in ("op3_chat_collapse", "op7_sharding", "op10_licenses"):
        plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow|ExistingRDD", plan), name
