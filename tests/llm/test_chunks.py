import numpy as np
import xxhash

from treeloom.llm import chunks as op


def slow_limits(raw):
    limits, last = [0], 0
    for end in range(1, len(raw) + 1):
        value = 0
        for byte in raw[max(0, end - 32) : end]:
            value = (value * 2 + int(op.GEAR[byte])) % 2**32
        while end - last > op.LONGEST:
            last += op.LONGEST
            limits.append(last)
        if value & int(op.MASK) == 0 and end - last >= op.SHORTEST:
            limits.append(end)
            last = end
    return limits if last == len(raw) else [*limits, len(raw)]


def test_limits_equal_a_rolling_hash(prose, monkeypatch):
    for text in (prose(400, 1), "a" * 2000, "", "é", prose(3, 2)):
        raw = text.encode()
        want = slow_limits(raw)
        assert op.chunk_limits(np.frombuffer(raw, np.uint8)) == want
        monkeypatch.setattr(op, "PIECE", 100)
        assert op.chunk_limits(np.frombuffer(raw, np.uint8)) == want
        monkeypatch.setattr(op, "PIECE", 1 << 20)


def test_chunks_come_back_after_an_insertion(prose):
    raw = prose(500, 3).encode()
    def cut(data):
        ends = op.chunk_limits(np.frombuffer(data, np.uint8))
        return {data[a:b] for a, b in zip(ends, ends[1:])}
    assert len(cut(raw) - cut(raw[:700] + b"insert" + raw[700:])) <= 4


def brute(frame_rows, least):
    """Repeated passages of distinct (id, text hash, text) rows, by a dictionary of chunks in order."""
    seen, out = {}, []
    for key, _, text in sorted(frame_rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        raw = (text or "").encode()
        limits, run = op.chunk_limits(np.frombuffer(raw, np.uint8)), []
        for start, end in [*zip(limits, limits[1:]), (0, 0)]:
            digest = xxhash.xxh3_128_digest(raw[start:end])
            if end and digest in seen:
                run.append((start, end, seen[digest]))
                continue
            if run and run[-1][1] - run[0][0] >= least:
                first = max(run, key=lambda r: (r[1] - r[0], -r[0]))[2]
                out.append((key, run[0][0], run[-1][1], len(run), first))
            run = []
            seen.setdefault(digest, key)
    return sorted(out, key=str)


def test_equals_a_dictionary(spark, docs_of, corpus, prose):
    from pyspark.sql import functions as F

    shared = prose(70, 77)
    rows = corpus + [(200, prose(40, 78) + " " + shared + prose(30, 79)), (201, shared + " " + prose(99, 80)), (202, prose(33, 81) + shared)]
    frame = docs_of(rows)
    got = sorted((tuple(r) for r in op.repeated_passages(frame).collect()), key=str)
    assert got == brute([tuple(r) for r in frame.select("doc_id", F.xxhash64("text"), "text").distinct().collect()], 120)
    assert {201, 202} <= {r[0] for r in got} and 200 not in {r[0] for r in got}
    cut = {r["doc_id"]: r["text"] for r in op.substring_dedup(frame).where("doc_id >= 200").collect()}
    assert cut[200] == rows[-3][1] and len(cut[201]) < len(rows[-2][1]) - 200 and len(cut[202]) < len(rows[-1][1]) - 200


def test_empty_table(docs_of):
    assert op.repeated_passages(docs_of([])).collect() == []
    assert op.substring_dedup(docs_of([(1, None)])).collect()[0]["text"] is None


def test_chunks_are_shuffled_with_one_place(docs_of, prose):
    """Chunks are counted beside their first place; rows that repeat both id and text are still one document."""
    docs = docs_of([(1, prose(80, 70)), (1, prose(80, 70)), (2, prose(80, 71))])
    assert op._runs(docs, "doc_id", "text").collect() == []
    assert "max(struct(id" not in op._runs(docs, "doc_id", "text")._jdf.queryExecution().optimizedPlan().toString()


def test_chunks_that_occur_once_are_not_dealt(docs_of, corpus, prose, monkeypatch):
    """The filter lets every repeated chunk pass and nearly no other, whatever the buckets and what a task holds."""
    from collections import Counter

    shared = prose(90, 500)
    docs = docs_of(corpus + [(300 + k, f"{prose(400, 501 + k)} {shared}") for k in range(9)])
    for entries, held in ((op.ENTRIES, op.HELD), (20, 1)):
        monkeypatch.setattr(op, "ENTRIES", entries)
        monkeypatch.setattr(op, "HELD", held)
        every = [(r["d0"], r["d1"]) for r in op.chunks(docs).collect()]
        passed = Counter((r["d0"], r["d1"]) for r in op.chunks(docs, met=op.may_repeat(docs)).collect())
        times = Counter(every)
        assert {key: n for key, n in times.items() if n > 1}.items() <= passed.items() <= times.items()
        assert sum(times[key] == 1 for key in passed) <= 0.01 * len(times) and len(passed) < 0.2 * len(times)


def test_ends_found_with_and_without_a_broadcast(docs_of, corpus, monkeypatch):
    want = sorted(op.whole_passages(docs_of(corpus)).collect(), key=str)
    monkeypatch.setattr(op, "FEW_ENDS", 0)
    monkeypatch.setattr(op, "REACH", 24)
    assert want and sorted(op.whole_passages(docs_of(corpus)).collect(), key=str) == want
