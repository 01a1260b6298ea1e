import random

import numpy as np

from symgraph.llm.origin import GENERATED_HEADER, KINDS, LIBRARY_HEADER, PARTS, SIZE, best_threshold, feature_index, fit_classifiers, fit_kind, giveaways, masked, not_hand_written, parts_of, scored, split_header, train, weighted

WORDS = "route gauge lens anchor chunk digest filter marker notch pivot quota relay shard span token valve window".split()


def hand(rng):
    w = rng.choice
    out = ["import json", ""]
    for _ in range(rng.randrange(2, 6)):
        out += [f"def {w(WORDS)}_{w(WORDS)}({w(WORDS)}, {w(WORDS)}={rng.randrange(9)}):", f"    # the {w(WORDS)} may be shared", f"    if {w(WORDS)} > {rng.randrange(900)}:", f"        return {w(WORDS)} + {rng.randrange(99)}", f"    return {w(WORDS)}", ""]
    return "\n".join(out)


def made(rng):
    fields = [f"{rng.choice(WORDS).upper()}_{i}" for i in range(1, rng.randrange(6, 20))]
    return "import struct\n\nclass AMessage:\n" + "".join(f"    {f} = {i}\n" for i, f in enumerate(fields)) + "\n" + "".join(f"def get_{f.lower()}(msg):\n    return msg[{i}]\n\n" for i, f in enumerate(fields))


def small(rng):
    return ";".join(f"var {rng.choice('abcxyz')}{i}=function(a){{for(var b=0;b<{rng.randrange(99)};b++)a+=b;return a}}" for i in range(rng.randrange(12, 30)))


def data(rng):
    return "TABLE = [\n" + "".join("    " + ", ".join(f"0x{rng.randrange(256):02x}" for _ in range(12)) + ",\n" for _ in range(rng.randrange(6, 30))) + "]\n"


def corpus(n=500):
    rng, rows, truth = random.Random(7), [], {}
    for i in range(n):
        repo, kind = f"repo{i % 9}", rng.choice(["hand"] * 7 + ["made", "small", "data", "library", "library"])
        folder, ext, text = rng.choice(["src", "lib/net", "tests"]), "py", hand(rng)
        if kind == "made":
            text = (f"# Code generated by tool{i % 5} v1.{i % 7}; DO NOT EDIT.\n\n" if rng.random() < 0.7 else "") + made(rng)
        elif kind == "small":
            ext, text = "min.js" if rng.random() < 0.5 else "js", small(rng)
        elif kind == "data":
            text = data(rng)
        elif kind == "library":
            if rng.random() < 0.5:
                folder = f"{rng.choice(['vendor', 'third_party'])}/pkg"
            else:
                text = f"# This file belongs to pkg{i % 4}, a third-party library (release 1.{i % 7}).\n\n" + text
        elif rng.random() < 0.3:
            text = rng.choice(["# Copyright (c) 2023 the gauge team. All rights reserved.\n\n", "# The caller writes the line 'Code generated by tool' on top of its output\n\n", "NOTE = '''\n# DO NOT EDIT, written by the exporter\n'''\n"]) + text
        path = f"{repo}/{folder}/f{i}.{ext}"
        rows.append((path, repo, ext.split(".")[-1].upper(), text))
        truth[path] = kind != "hand"
    return rows, truth


def test_found_against_truth(spark):
    rows, truth = corpus()
    rows += rows[:20] + [("repo1/src/null.py", "repo1", "py", None), ("repo1/src/blank.py", "repo1", "py", "  \n"), (None, None, "py", "x = 1"), ("repo2/vendor/pkg/broken.py", "repo2", "py", "def f(:\n"), ("repo2/vendor/pkg/notes.txt", "repo2", "txt", "kept by hand"), ("repo3/src/long.py", "repo3", "py", "x = 1\n" * 60_000)]
    df = spark.createDataFrame([(*r, "k") for r in rows], "path string, repo string, ext string, text string, kind string")
    got = {r.path: r.kind for r in not_hand_written(df).collect()}
    right = sum(truth.get(p, p.endswith("notes.txt")) for p in got)
    assert right / len(got) > 0.98 and right / (sum(truth.values()) + 1) > 0.98
    assert "repo2/vendor/pkg/broken.py" not in got and "repo1/src/null.py" not in got and len(got) == not_hand_written(df).count()


def test_empty_and_tiny(spark):
    schema = "path string, repo string, ext string, text string"
    assert not_hand_written(spark.createDataFrame([], schema)).collect() == []
    assert not_hand_written(spark.createDataFrame([("a/src/x.py", "a", "py", "x = 1\n")], schema)).collect() == []


def test_sample_is_bounded(spark):
    rows, _ = corpus(300)
    df = spark.createDataFrame(rows, "path string, repo string, ext string, text string")
    some, every = fit_classifiers(df, 100).report, fit_classifiers(df, 1000).report
    assert all(60 < r[1] < 140 for r in some) and all(r[1] == 300 for r in every) and [r[0] for r in every] == list(KINDS)


def test_giveaways_and_headers():
    assert giveaways("r/src/a.go", "// Code generated by x v1; DO NOT EDIT.\n\npackage a\n") == {"generated"}
    assert giveaways("r/src/a.go", "// It writes 'Code generated by x; DO NOT EDIT.' at the top\n\npackage a\n") == set()
    assert giveaways("r/src/vendor_portal/a.go", "package a\n") == set() and giveaways("r/vendor/x/a.go", "package a\n") == {"third_party"}
    assert giveaways("r/src/a.c", "/* Licensed under the Apache License, Version 2.0 */\nint a;\n") == {"third_party"}
    assert split_header("#!/bin/x\n// a\n\n/* b */\ncode // c\n") == ("// a\n\n/* b */", "\ncode // c\n")
    assert split_header("#include <a.h>\n")[0] == "" and split_header("#![allow(x)]\n")[0] == ""


def test_giveaways_are_masked():
    for header in ("// Code generated by x v1; DO NOT EDIT.", "# @generated", "/* a third-party library */", "// Changes may be lost if the code is regenerated", "# Redistribution and use in source and binary forms"):
        left = masked(header)
        assert not GENERATED_HEADER.search(left) and not LIBRARY_HEADER.search(left) and "\x01" in left
    assert masked("// Owned by Team 12") == "// owned by team 0"


def test_features_have_three_groups():
    index, value = weighted(feature_index("r/vendor/a.go", "// note\n\npackage a\n"))
    assert (np.diff(index) > 0).all() and index[-1] < SIZE and abs(float(value @ value) - 3) < 1e-5
    index, value = weighted(feature_index("r/a.go", ""))
    assert len(index) == 2 and abs(float(value @ value) - 1) < 1e-5


def test_parts_are_balanced_and_held_out():
    repos = ["a"] * 50 + ["b"] * 30 + ["c"] * 20 + ["d"] * 10 + ["e"] * 10
    sizes = np.bincount([parts_of(repos)[r] for r in repos])
    assert sizes.max() == 50 and sizes.min() >= 30
    # what is learned for a part does not depend on its own rows
    rng = np.random.default_rng(3)
    rows = [(np.array([i % 7 == 0, 2 + rng.integers(50)], np.int64), np.array([1, 1], np.float32)) for i in range(90)]
    labels, part = np.array([i % 7 == 0 for i in range(90)]), np.arange(90) % PARTS
    one, _ = fit_kind(rows, labels, part)
    two, _ = fit_kind([(np.array([3, 4]), v) if part[i] == 0 else (x, v) for i, (x, v) in enumerate(rows)], labels ^ (part == 0), part)
    assert (one[0][0] == two[0][0]).all() and one[0][1:] == two[0][1:]


def test_training_separates():
    rng = np.random.default_rng(1)
    rows = [(np.array([0 if y else 1, 2 + rng.integers(50)]), np.array([1, 1], np.float32)) for y in (i % 4 == 0 for i in range(200))]
    y = np.array([i % 4 == 0 for i in range(200)])
    w, b = train(rows, y, 64)
    scores = scored((w, b), rows)
    known = y & (np.arange(200) % 8 == 0)  # giveaways of half of them
    assert ((scores > best_threshold(scores, known)) == y).all() and best_threshold(scores, np.zeros(200, bool)) == 0
