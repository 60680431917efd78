import random
import re

from lodestrata.llm import splitting


def count(text):
    return len(re.findall("\r\n|\n|\r", text)) + (1 if text and text[-1] not in "\r\n" else 0)


def test_pieces_rebuild_the_content(chunks):
    r = random.Random(4)

    def some(n):
        return "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))

    texts = ["".join(f"x{i}\n" for i in range(61)), some(5000), "".join(some(300) + "\n" for _ in range(20)), "short", "", None, "b" * 2048]
    texts += ["\r\n".join(some(30) for _ in range(130)), "".join(f"q{i}\r" for i in range(70)), some(1900) + "\n" + some(900)]
    texts += ["\n".join(some(8) + r.choice(["", "}", "    a = b;", "def f():", some(r.randint(0, 400))]) for _ in range(r.randint(1, 200))) for _ in range(25)]
    rows = [(f"c{i}", "f", t) for i, t in enumerate(texts)] + [("c0", "f", texts[0])]
    got = {}
    for p in splitting.split_oversized(chunks(rows)).collect():
        got.setdefault(p["id"], []).append(p)
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        pieces = sorted(got[f"c{i}"], key=lambda p: p["piece"])
        assert [p["piece"] for p in pieces] == list(range(1, len(pieces) + 1)) and pieces[0]["pieces"] == len(pieces)
        if text is None:
            assert pieces[0]["content"] is None
            continue
        assert (len(pieces) > 1) == (len(text) > 2048 or count(text) > 60)
        whole, at = pieces[0]["content"], 0
        for before, p in zip(pieces, pieces[1:]):
            body, best = p["content"], None
            assert len(body) <= 2048 and count(body) <= 60
            line = p["start_line"]
            for shared in range(min(len(body), len(before["content"])), -1, -1):
                if before["content"].endswith(body[:shared]) and text.startswith(whole + body[shared:]) and count(body[:shared]) <= 10:
                    best = shared
                    break
            assert best is not None
            whole += body[best:]
            assert line >= before["start_line"]
        assert whole == text


def test_boundary_and_overlap(chunks):
    text = "".join(f"def f{i}():\n" + "".join(f"    x{k} = {k}\n" for k in range(12)) + "\n" for i in range(10))
    pieces = sorted(splitting.split_oversized(chunks([("a", "f", text)])).collect(), key=lambda p: p["piece"])
    assert all(p["content"].endswith("\n\n") for p in pieces[:-1])
    assert all(b["start_line"] == a["end_line"] - 9 for a, b in zip(pieces, pieces[1:]))
    assert splitting.oversized_ids(splitting.split_oversized(chunks([]))).count() == 0


def test_time_grows_with_length(spark, chunks):
    import time

    def took(n):
        line = "    value = call(argument, other)\n"
        df = chunks([("a", "f", line * (n // len(line)))])
        began = time.time()
        assert splitting.split_oversized(df).count() > n // 2100
        return time.time() - began

    took(50_000)
    assert took(1_000_000) < 10


def test_lines_of_pieces(chunks):
    text = "".join(f"l{i}\n" for i in range(1, 200)) + "y" * 5000 + "\nend\n"
    for p in splitting.split_oversized(chunks([("a", "f", text)])).collect():
        first = p["content"].split("\n")[0]
        if first.startswith("l"):
            assert p["start_line"] == int(first[1:])
        assert p["start_line"] <= 201 and (not first.startswith("y") or p["start_line"] == 200)
