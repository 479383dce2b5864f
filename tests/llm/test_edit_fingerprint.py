import random
from hashlib import sha256

import numpy as np

from repolens.llm import edit_fingerprint as E
from repolens.llm.queries import op9_edit_fingerprint


def prose(rng, n):
    return " ".join("".join(rng.choices("etaoinshrdluéß", k=rng.randint(2, 9))) for _ in range(n))


def expected(rows):
    """doc_id -> (n_chars, sha of the edited text, text, edited, next text)."""
    order = sorted(((i, t or "") for i, t in rows), reverse=True)
    out = {}
    for k, (i, t) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        new = t[: len(t) - half] + nxt[:half]
        out[i] = (len(t), sha256(new.encode()).hexdigest(), t, new, nxt)
    return out


def test_a_text_alone_equals_a_text_in_a_batch():
    rng = random.Random(1)
    texts = ["", "a", "ab", prose(rng, 3), "x" * 5000, prose(rng, 4000), prose(rng, 60), "日本" * 40, "", prose(rng, 60)]
    together = E.fingerprints(texts)
    for t, f in zip(texts, together):
        assert (E.fingerprints([t])[0] == f).all()
    assert not together[0].any() and not (together[6] == together[9]).all()


def test_likeness_falls_with_edits():
    rng = random.Random(2)
    means = []
    for edits in (0, 3, 30, 300):
        near = []
        for _ in range(20):
            t = prose(rng, 500)
            u = list(t)
            for _ in range(edits):
                at = rng.randrange(len(u))
                u[at : at + 1] = rng.choice([[], ["q"], [u[at], "q"]])
            near.append(E.likeness(*map(np.atleast_2d, E.fingerprints([t, "".join(u)])))[0])
        means.append(np.mean(near))
    assert means[0] == 1 and means[1] > 0.9 and means[1] > means[2] > means[3] and means[2] > 0.5
    halves = [E.likeness(*map(np.atleast_2d, E.fingerprints([a + b, a + c])))[0] for a, b, c in ([prose(rng, 250) for _ in range(3)] for _ in range(20))]
    others = [E.likeness(*map(np.atleast_2d, E.fingerprints([prose(rng, 500), prose(rng, 500)])))[0] for _ in range(20)]
    assert 0.3 < np.mean(halves) < 0.7 and np.mean(others) < 0.15


def test_query(spark):
    for sf in ("sf0.001", "sf0.01"):
        rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").collect()]
        want = expected(rows)
        got = op9_edit_fingerprint(spark, f"/root/testdata/{sf}").collect()
        assert len(got) == len(rows)
        for r in got:
            n, sha, text, new, nxt = want[r.doc_id]
            assert (r.n_chars, r.edited_sha256) == (n, sha)
        for r in got[::25]:
            _, _, text, new, nxt = want[r.doc_id]
            f = E.fingerprints([text, new, nxt])
            assert (r.fingerprint, r.edited_fingerprint) == (f[0].tobytes().hex(), f[1].tobytes().hex())
            assert (r.near_edited, r.near_next) == (E.likeness(f[:1], f[1:2])[0], E.likeness(f[:1], f[2:])[0])


def test_ranges_and_rows(spark):
    rng = random.Random(6)
    rows = [(i * 8 % 1001 - 300, prose(rng, rng.randint(0, 30))) for i in range(300)] + [(5000, None), (5001, ""), (5002, "é")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as bucket", "2 as ghost").repartition(4)
    want = expected(rows)
    for parts in (1, 7, 40):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", parts < 40)
        got = E.with_edits(df).collect()
        assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in got} == {i: w[:2] for i, w in want.items()} and len(got) == len(rows)
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", True)
    odd = spark.createDataFrame([(None, "aaaa"), (None, "bbbb"), (1, "cccc"), (1, "dddd")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.edited_sha256) for r in E.with_edits(odd).collect())
    assert got == sorted([(1, sha256(b"ddcc").hexdigest()), (1, sha256(b"ccbb").hexdigest()), (0, sha256(b"bbaa").hexdigest()), (0, sha256(b"aadd").hexdigest())])
    assert E.with_edits(df.limit(0)).count() == 0
    one = E.with_edits(df.filter("doc_id = 5002")).collect()
    assert len(one) == 1 and one[0].near_next == 1


def test_near_groups(spark):
    rng = random.Random(8)
    base = prose(rng, 400)
    rows = [(0, base), (1, base), (2, base.replace("e", "x", 3)), (3, prose(rng, 400)), (4, None), (5, ""), (None, base), (1, base)]
    prints = E.fingerprint(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as key"), "doc_id")
    near = {r.fingerprint: r.near_id for r in E.near_groups(prints).collect()}
    assert [near[r.fingerprint] for r in prints.filter("doc_id is not null").orderBy("doc_id").collect()] == [0, 0, 0, 0, 3, 4, 4]
    assert E.near_groups(prints.limit(0)).count() == 0


def test_no_candidate_is_lost_and_recall(spark):
    """Families of fingerprints, one of them large, among many others: against all pairs."""
    rng = np.random.default_rng(5)
    others = rng.integers(0, 2, (9000, 256))
    families = []
    for size in (400, *[12] * 80):
        family = np.repeat(rng.integers(0, 2, (1, 256)), size, axis=0)
        families.append(family ^ (rng.random(family.shape) < rng.uniform(0.01, 0.07, (size, 1))))
    bits = np.concatenate([others, *families]).astype(np.uint8)
    packed = np.packbits(bits, axis=1)
    df = spark.createDataFrame([(i, p.tobytes().hex()) for i, p in enumerate(packed)], "doc_id long, fingerprint string")
    keys = {r.node: set(r.keys) for r in E.band_keys(df.withColumnRenamed("doc_id", "node"), E.TABLES, E.SAMPLED).collect()}
    near = {r.fingerprint: r.near_id for r in E.near_groups(df).collect()}
    label = np.array([near[p.tobytes().hex()] for p in packed])
    root = list(range(len(packed)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    pairs = found = 0
    for i in range(len(packed)):
        for j in i + 1 + np.flatnonzero(np.bitwise_count(packed[i + 1 :] ^ packed[i]).sum(1) <= 25):
            pairs += 1
            found += label[i] == label[j]
            if keys[i] & keys[j]:
                root[max(find(i), find(j))] = min(find(i), find(j))
    assert [find(i) for i in range(len(packed))] == label.tolist()
    assert pairs > 5000 and found >= 0.98 * pairs


def walked(text):
    """The fingerprint by plain loops over each segment's walk."""
    mask = (1 << 64) - 1

    def mix(x):
        x ^= x >> 30
        x = x * 0xBF58476D1CE4E5B9 & mask
        x ^= x >> 27
        x = x * 0x94D049BB133111EB & mask
        return x ^ x >> 31

    low = (1 << 32) - 1
    cuts = [0]
    for i, c in enumerate(text):
        h = ord(c) * 0x9E3779B1 & low
        if i > 0:
            h += ord(text[i - 1]) * 0x85EBCA77
        if i > 1:
            h += ord(text[i - 2]) * 0xC2B2AE3D
        h &= low
        h ^= h >> 15
        h = h * 0x2C1B3C6D & low
        h ^= h >> 13
        if i >= 2 and h % E.MEAN == 0 and i + 1 < len(text):
            cuts.append(i + 1)
    pieces = []
    for a, b in zip(cuts, [*cuts[1:], len(text)]):
        pieces += [text[x : min(x + E.LONGEST, b)] for x in range(a, b, E.LONGEST)]
    votes, n = [0] * E.BITS, 0
    for p in pieces:
        at, steps = 0, []
        for j in range(2 * len(p) + 1):
            c = ord(p[at]) if at < len(p) else 0
            steps.append(c)
            bit = (c ^ int(E._STEP[j])) * 0x85EBCA6B & low
            bit ^= bit >> 15
            bit = bit * 0xC2B2AE35 & low
            at += (bit >> 31) if at < len(p) else 0
        for band in range(E.BANDS):
            value = (band + 1) * 0xA0761D6478BD642F & mask
            for share in E.SAMPLES[band]:
                value = mix(value + steps[int(share * 2 * len(p))] + 1 & mask)
            value = mix(value ^ len(p).bit_length() * 0xE7037ED1A0B428DB & mask)
            n += 1
            for lane in range(E.BITS // 64):
                m = lane * 0x8EBC6AF09C88C6E3 + 1 & mask
                word = mix(value * m + m & mask).to_bytes(8, "little")
                for k in range(64):
                    votes[lane * 64 + k] += word[k // 8] >> 7 - k % 8 & 1
    return "".join(str(int(2 * v > n)) for v in votes) if n else "0" * E.BITS


def test_walks_against_plain_loops():
    rng = random.Random(12)
    for t in ["", "a", "ab", "abc" * 100, prose(rng, 5), prose(rng, 200), "日本語" * 70, "x" * 1000]:
        assert "".join(map(str, np.unpackbits(E.fingerprints([t])[0]))) == walked(t)


def test_near_ids_of_the_query_against_all_pairs(spark):
    """No document is with another that no chain of near pairs reaches, and nearly every near pair is together."""
    sf = "/root/testdata/sf0.01"
    rows = sorted((r.doc_id, r.fingerprint, r.near_id) for r in op9_edit_fingerprint(spark, sf).collect())
    bits = np.array([np.frombuffer(bytes.fromhex(f), np.uint8) for _, f, _ in rows])
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    near = []
    for i in range(len(rows)):
        for j in i + 1 + np.flatnonzero(np.bitwise_count(bits[i + 1 :] ^ bits[i]).sum(1) <= 25):
            near.append((i, j))
            root[max(find(i), find(j))] = min(find(i), find(j))
    least = [rows[find(i)][0] for i in range(len(rows))]
    groups = {}
    for d, _, n in rows:
        groups.setdefault(n, []).append(d)
    at = {d: i for i, (d, _, _) in enumerate(rows)}
    assert all(n == min(g) for n, g in groups.items())
    assert all(len({least[at[d]] for d in g}) == 1 for g in groups.values())
    together = sum(rows[i][2] == rows[j][2] for i, j in near)
    assert len(near) > 20 and together >= 0.95 * len(near)


def test_recall_of_edited_texts(spark):
    """Whole documents with a few edits of characters, spread over them: near by their texts, not by planted bits."""
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect() if len(r.text or "") > 1500]
    docs = list(dict.fromkeys(docs))[:150]
    rng = random.Random(8)
    rows = []
    for i, t in enumerate(docs):
        u = list(t)
        for _ in range(max(1, len(t) // 1000)):
            u[rng.randrange(len(u))] = rng.choice("qxz")
        rows += [(2 * i, t), (2 * i + 1, "".join(u))]
    prints = spark.createDataFrame([(i, f.tobytes().hex()) for (i, _), f in zip(rows, E.fingerprints([t for _, t in rows]))], "doc_id long, fingerprint string")
    of = {r.doc_id: r.near_id for r in prints.join(E.near_groups(prints), "fingerprint").collect()}
    found = sum(of[2 * i] == of[2 * i + 1] for i in range(len(docs))) / len(docs)
    print("recall of edited texts", found)
    assert len(docs) > 100 and found >= 0.9
