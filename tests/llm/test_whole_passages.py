from treeloom.llm import chunks as op


def test_passages_of_just_over_fifty_words_are_whole(docs_of, prose, monkeypatch):
    monkeypatch.setattr(op, "REACH", 24)  # several rounds
    rows, want = [], {}
    for k in range(120):
        passage = prose(50 + k % 11, 3000 + k)
        rows.append((k, f"{prose(20 + k % 7, 4000 + k)} A{passage}Z {prose(30, 5000 + k)}"))
        before = f"{prose(9 + k % 13, 6000 + k)[: 40 + k]}é"
        rows.append((1000 + k, f"{before}{passage}è {prose(25, 7000 + k)}"))
        want[1000 + k] = (len(before.encode()), len(before.encode()) + len(passage), k)
    rows.append((None, None))
    got = {}
    for r in op.whole_passages(docs_of(rows)).collect():
        got.setdefault(r["doc_id"], []).append((r["start"], r["end"], r["first_doc_id"]))
    assert got == {key: [span] for key, span in want.items()}


def test_equal_bytes_keeps_letters():
    assert op.equal_bytes("né".encode(), "nê".encode(), True) == 1 and op.equal_bytes("éab".encode(), "ƥab".encode(), False) == 2
    assert op.equal_bytes(b"", b"a", True) == 0 and op.equal_bytes(b"xab", b"ab", False) == 2


def test_whole_passages_of_odd_rows(docs_of, corpus):
    spans = op.whole_passages(docs_of(corpus)).collect()
    size = {}
    for key, text in corpus:
        size[key] = max(size.get(key, 0), len((text or "").encode()))
    assert spans and all(0 <= r["start"] and r["end"] <= size[r["doc_id"]] and r["end"] - r["start"] >= 120 for r in spans)
    assert {r["doc_id"] for r in op.repeated_passages(docs_of(corpus)).collect()} <= {r["doc_id"] for r in spans}
    assert op.whole_passages(docs_of([])).collect() == []
