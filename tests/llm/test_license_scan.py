import math
import random
import textwrap
from collections import Counter

from emberlog.llm.license_scan import OPENINGS, TEMPLATES, TEXTS, Matcher, scan_licenses, term_weights, terms

SCHEMA = "doc_id long, path string, text string, license string, directory int"


def rows():
    rng = random.Random(1)
    filler = [f"word{k}" for k in range(50)] + ["the", "license", "under", "this", "work"]
    out = []
    for k in range(120):
        text = "\n".join(" ".join(rng.choices(filler, k=12)) for _ in range(rng.randint(0, 6)))
        if k % 4 == 0:
            text += "\n" + rng.choice(TEMPLATES)[1] + rng.choice(["", " Extra."])
        out.append((k, f"src/p{k % 6}/lib/f{k}.py", text))
    out += [(500, "src/p1/LICENSE", TEMPLATES[0][1]), (501, "src/LICENSE", TEMPLATES[5][1]), (502, None, "no path"),
            (503, "top.txt", None), (504, "src/p1/lib/deep/x.py", ""), (505, "src/p9/x.py", "plain " * 30_000),
            (506, "other/x.py", "nothing"), (507, "src/p1/lib/deep/x.py", ""), (None, "src/p2/y.py", "nothing")]
    return out


def brute(data):
    """Every line against every template, every document against every directory above it."""
    n = len(data)
    frequency = Counter(t for _, _, text in data for t in set(terms(text or "")))
    known = {t for _, text in TEMPLATES for t in terms(text)}
    weight = lambda t: math.log((n + 1) / (frequency[t] + 1)) + 1 if t in known else math.log(n + 1) + 1
    vector = lambda words: {t: (1 + math.log(c)) * weight(t) for t, c in Counter(words).items()}

    def cosine(a, b):
        dot = sum(w * b.get(t, 0) for t, w in a.items())
        return dot / math.sqrt(sum(w * w for w in a.values()) * sum(w * w for w in b.values())) if a and b else 0

    best = lambda text: max((round(cosine(vector(terms(text)), vector(terms(t))), 9), name) for name, t in TEMPLATES)
    own, files, out = {}, {}, []
    for key, (doc, path, text) in enumerate(data):
        lines = [best(line) for line in (text or "").split("\n")]
        top = max(lines, key=lambda x: x[0])
        own[key] = top if top[0] >= 0.75 else None
        if own[key] and path and best(text)[0] >= 0.75:
            folder = path.rpartition("/")[0]
            files[folder] = max(files.get(folder, (0, 0, "")), (own[key][0], -doc, own[key][1]))
    for key, (doc, path, _) in enumerate(data):
        license, origin = (own[key][1], "own") if own[key] else (None, None)
        folder = path.rpartition("/")[0] if path else None
        while license is None and folder is not None:
            if folder in files:
                license, origin = files[folder][2], "inherited"
            folder = folder.rpartition("/")[0] if folder else None
        out.append((doc or -1, license, origin))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    data = rows()
    docs = spark.createDataFrame([(i, p, t, "x", 1) for i, p, t in data], SCHEMA).repartition(3)
    found = scan_licenses(docs).collect()
    mine = sorted(((r.doc_id or -1, r.license, r.origin) for r in found), key=str)
    assert mine == brute(data)
    assert {o for _, _, o in mine} == {"own", "inherited", None}
    assert scan_licenses(docs.limit(0)).count() == 0


def test_weights_cover_all_documents(spark):
    data = rows()
    docs = spark.createDataFrame([(t,) for _, _, t in data], "text string").repartition(4)
    idf, unseen = term_weights(docs, TEMPLATES)
    holding = sum("license" in terms(t or "") for _, _, t in data)
    assert abs(idf["license"] - math.log((len(data) + 1) / (holding + 1)) - 1) < 1e-12
    assert Matcher(TEMPLATES, idf, unseen).best(terms(TEMPLATES[3][1]))[1] == "Apache-2.0"


def test_wrapped_headers_and_whole_licences(spark):
    wrap = lambda text, mark="", width=60: "\n".join(mark + x for x in textwrap.wrap(text, width))
    code = "\n".join(f"value{k} = call{k % 7}(value{k + 1})" for k in range(300))
    mit, bsd3, bsd2 = (text for _, text in TEXTS)
    holder = "Copyright (c) 2020, Some Body\nAll rights reserved.\n\n"
    later = ", or (at your option) any later version."
    data = [("a/gpl.py", wrap(TEMPLATES[6][1] + later, "# ") + "\n" + code, "GPL-3.0", "own"),
            ("a/gpl.bat", code + "\n" + wrap(TEMPLATES[6][1] + later, "REM "), "GPL-3.0", "own"),
            ("a/gpl2.c", "/*\n" + wrap(TEMPLATES[20][1] + later, " * ") + "\n */\n" + code, "GPL-2.0", "own"),
            ("a/bsd.c", wrap(holder + TEMPLATES[10][1], "// ", 40) + "\n" + code, "BSD-3-Clause", "own"),
            ("a/other.py", code, None, None),  # headers give nothing to others
            ("mit/LICENSE", "MIT License\n\nCopyright (c) 2020 Some Body\n\n" + wrap(mit), "MIT", "own"),
            ("bsd3/LICENSE", holder + wrap(bsd3), "BSD-3-Clause", "own"),
            ("bsd2/LICENSE", holder + wrap(bsd2), "BSD-2-Clause", "own"),
            ("apache/LICENSE", wrap(OPENINGS[0][1]) + "\n" + "legal terms of it " * 900, "Apache-2.0", "own"),
            ("lgpl/COPYING", wrap(OPENINGS[3][1]) + "\n" + "legal terms of it " * 900, "LGPL-3.0", "own"),
            ("a/talk.txt", code + "\n" + OPENINGS[0][1], None, None)]
    data += [(f"{folder}/x.py", code, name, "inherited") for folder, name in (
        ("mit", "MIT"), ("bsd3", "BSD-3-Clause"), ("bsd2", "BSD-2-Clause"), ("apache", "Apache-2.0"), ("lgpl", "LGPL-3.0"))]
    docs = spark.createDataFrame([(k, p, t) for k, (p, t, _, _) in enumerate(data)], "doc_id long, path string, text string")
    found = {r.path: (r.license, r.origin) for r in scan_licenses(docs).collect()}
    assert found == {p: (name, origin) for p, _, name, origin in data}
