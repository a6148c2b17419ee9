"""The method's part of the secret scan: power by encoding, discoveries among decoys, thresholds by brute force."""

import random

from veritide.llm import secretscan

WORDS = "account balance build cache client config customer default document element factory handler index invoice manager network number object page parser provider query record request response service session status string system table update user value version window".split()


def decoy(rng):
    words = [rng.choice(WORDS) for _ in range(rng.randint(3, 6))]
    form = rng.randrange(4)
    if form == 0:
        return words[0] + "".join(w.title() for w in words[1:]) + str(rng.randrange(100))
    if form == 1:
        return "-".join(words) + f"-{rng.randrange(2000, 2030)}"
    if form == 2:
        return "/".join(words) + f"/{rng.randrange(10)}"
    return "_".join(w.upper() for w in words) + f"_{rng.randrange(1000)}"


def test_recall_by_encoding_and_false_discoveries(spark):
    rng = random.Random(12)
    rows, planted, decoys = [], {}, 0
    for e, (_, alphabet) in enumerate(secretscan.ENCODINGS):
        for k in range(120):
            token = "".join(rng.choice(alphabet) for _ in range(rng.randint(24, 48)))
            if secretscan.HEX.search(token):
                continue  # the base pattern has it
            i = len(rows)
            planted[i] = (e, f"random:{len('see ')}:{len('see ') + len(token)}")
            rows.append((i, f"see {token} end"))
    for _ in range(3000):
        rows.append((len(rows), f"use {decoy(rng)} and {decoy(rng)}"))
        decoys += 2
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = {r["doc_id"]: r["spans"] for r in secretscan.secret_digest(secretscan.secret_spans(frame)).collect()}
    for e, (name, _) in enumerate(secretscan.ENCODINGS):
        own = [(i, span) for i, (x, span) in planted.items() if x == e]
        assert sum(span in got[i].split(",") for i, span in own) >= 0.9 * len(own), name
    false = sum("random" in got[i] for i in range(len(planted), len(rows)) if i not in planted)
    found = sum("random" in x for x in got.values())
    assert false <= 2 * secretscan.ALPHA * found


def test_thresholds_are_benjamini_hochberg():
    rng = random.Random(13)
    for _ in range(200):
        steps = [rng.choice([0, 0, 0, 1, 3, 8, 14, 20, 40, 60]) for _ in range(rng.randint(1, 60))]
        counts = {(0, s): steps.count(s) for s in set(steps)}
        p = sorted(2.0 ** (-s / 2) for s in steps)
        ranks = [r for r, x in enumerate(p, 1) if x <= 0.01 * r / len(p)]
        limit = p[ranks[-1] - 1] if ranks else None
        least = secretscan.thresholds(counts, 0.01).get(0)
        assert {s for s in steps if least is not None and s >= least} == {s for s in steps if limit is not None and 2.0 ** (-s / 2) <= limit}


def test_null_table_of_uniformity():
    """Under uniform characters the p-value holds its level, also where expected counts are below one."""
    rng = random.Random(14)
    for k in (16, 36, 64):
        found = []
        for _ in range(800):
            counts = [0] * k
            for _ in range(24):
                counts[rng.randrange(k)] += 1
            found.append(secretscan.uniform_p(counts, 24))
        for level in (0.05, 0.2, 0.5):  # ties count whole, so the test rejects a little less than its level
            share = sum(p <= level for p in found) / len(found)
            assert share < level + 0.04 and (k == 64 or share > 0.5 * level)
