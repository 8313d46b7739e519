from __future__ import annotations

import hashlib
import random
import re

from pyspark.sql import functions as F

from tabloom.llm import pii

RX = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base(text):
    out = []
    for rank, (kind, rx) in enumerate(RX.items()):
        for m in re.finditer(rx, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


def texts():
    rng = random.Random(2)
    atoms = ["a@b.c", "x_y@d.e", ".@", "@", "a.b.c@d-e.f.g.", "_d@e.f", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "000255.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112",
             "0445617099674829", "+1 (017) 555-7713", "+49 30 1234567 ", "+1", "++12 345 678 901", "é", "𝄞", "\n", " ", ",", "word", "7", "9" * 400 + ".1.1.1", "a@b", "-"]
    made = ["".join(rng.choice(atoms) + rng.choice(["", " ", "", ", "]) for _ in range(rng.randint(1, 25))) for _ in range(300)]
    return [*made, None, "", "x" * 20000, "1 " * 4000, "a.b@c.de " * 700, "a" + ".b" * 9000 + "@c" + ".d" * 9000]


def test_base_spans(spark):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {r.doc_id: r for r in pii.digest(docs).collect()}
    for i, t in rows:
        want = base(t)
        listed = ",".join(f"{k}:{s}:{e}" for s, _, e, k in want)
        assert got[i].base_sha256 == hashlib.sha256(listed.encode()).hexdigest(), (i, t)
        assert [got[i][f"n_{k}"] for k in RX] == [sum(w[3] == k for w in want) for k in RX]
        assert {x for x in listed.split(",") if x} <= set(got[i].spans.split(","))


def test_method_adds_and_learns(spark):
    rows = [(i, f"word token = \"{hashlib.sha1(str(i).encode()).hexdigest()}\" and more") for i in range(40)]
    rows += [(100 + i, f"call me by phone (212) 555-{1000 + i} now") for i in range(40)]
    rows += [(200 + i, f"invoice version {1000 + i}{2000 + i}{3000 + i}{1111 + i} x") for i in range(40)]
    rows += [(300, "plain words only"), (300, "plain words only"), (301, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit(1)).withColumn("base", F.lit(2))
    got = {r.doc_id: r.spans for r in pii.digest(docs).collect()}
    assert all(got[i].startswith("secret:5:") for i in range(40))
    assert all(got[100 + i] == f"phone:{17}:{31}" for i in range(40))
    assert sum(bool(got[200 + i]) for i in range(40)) <= 8  # those that pass the check by chance
    assert got[300] == "" and got[301] == ""
    assert pii.digest(docs.where("false")).collect() == []


def test_prefix_sums(spark):
    frame = spark.createDataFrame([([1] * 1000,), ([],), ([5, -2, 7],)], "x array<bigint>")
    got = [r[0] for r in frame.select(pii._prefix_sums(F.col("x"))).collect()]
    assert got == [list(range(1, 1001)), [], [5, 3, 10]]
