import base64
import random

import numpy as np
import pytest
import tiktoken

from lodestrata.llm import encoding, packing


@pytest.fixture(scope="module")
def public():
    import public_tokenizers

    own = encoding.encoder(encoding.vocabulary_path())
    return own, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})


def test_against_library(public):
    own, library = public
    r = random.Random(2)
    texts = ["", " ", "a" * 3000, "ab" * 2000, "\x1c \x85 x", "I'll we've DON'T", "<|endoftext|>"]
    texts += ["".join(r.choice("abcdeé ß漢٣\U0001f680\U00010400 \n\t'sre_0-9") for _ in range(r.randint(1, 80))) for _ in range(600)]
    for text in texts:
        assert np.frombuffer(own.encode(text), "<i4").tolist() == library.encode_ordinary(text)
        assert own.count(text) == len(library.encode_ordinary(text))


def test_rank_file_is_read_as_it_is():
    path = encoding.vocabulary_path()
    first = open(path, "rb").readline().split()
    assert encoding.encoder(path).ranks[base64.b64decode(first[0])] == int(first[1])


def test_table(documents, public):
    rows = [(1, "hello world"), (1, "hello world"), (2, None), (3, ""), (4, "x" * 20000)]
    got = sorted((r["doc_id"], list(r["ids"])) for r in encoding.encode_texts(documents(rows)).collect())
    assert [k for k, _ in got] == [1, 1, 2, 3, 4] and got[0] == got[1] and got[2][1] == got[3][1] == []
    assert got[4][1] == public[1].encode_ordinary("x" * 20000)
    assert encoding.encode_texts(documents([])).count() == 0


def test_packing(documents, public):
    r = random.Random(1)
    rows = [(i, " ".join(r.choice("pump ledger cache meter tile".split()) for _ in range(r.randint(1, 60)))) for i in range(300)]
    rows += [(900, None), (901, ""), (902, "word " * 450), (0, rows[0][1])]
    got = packing.pack(documents(rows), capacity=100, shard_docs=80).collect()
    sizes, parts = {}, {}
    for g in got:
        sizes[g["container"]] = sizes.get(g["container"], 0) + g["size"]
        parts.setdefault(g["doc_id"], []).append(g)
    assert max(sizes.values()) <= 100 and len(got) == len(rows) + len(parts[902]) - 1
    for i, text in rows:
        if i != 0:
            assert sum(p["size"] for p in parts[i]) == (len(public[1].encode_ordinary(text)) if text else 0)
            assert len(parts[i]) == 1 or i == 902
    assert sorted(p["part"] for p in parts[902]) == list(range(len(parts[902])))
    total = sum(sizes.values())
    assert len([s for s in sizes.values() if s]) <= -(-total // 100) * 1.05 + 1
    assert packing.pack(documents([])).count() == 0


def related(spark_rows, texts):
    """Mean share of common words between two documents of a container."""
    inside = {}
    for g in spark_rows:
        inside.setdefault(g["container"], []).append(set(texts[g["doc_id"]].split()))
    shares = [len(a & b) / len(a | b) for docs in inside.values() for i, a in enumerate(docs) for b in docs[:i]]
    return float(np.mean(shares))


def test_related_documents_lie_together(documents):
    r = random.Random(3)
    topics = [[f"t{k}word{j}" for j in range(60)] for k in range(12)]
    common = [f"common{j}" for j in range(200)]
    # a third of all documents are of one topic
    texts = {}
    for i in range(2400):
        topic = topics[0 if r.random() < 0.33 else r.randrange(12)]
        texts[i] = " ".join(r.choice(topic if r.random() < 0.6 else common) for _ in range(r.randint(5, 40)))
    got = packing.pack(documents(list(texts.items())), capacity=600, shard_docs=200).select("doc_id", "container", "size").collect()
    sizes = {}
    for g in got:
        sizes[g["container"]] = sizes.get(g["container"], 0) + g["size"]
    assert len(got) == len(texts) and max(sizes.values()) <= 600
    assert len(sizes) <= -(-sum(sizes.values()) // 600) * 1.03 + 1
    names = [g["container"] for g in got]
    r.shuffle(names)
    shuffled = [{"doc_id": g["doc_id"], "container": n} for g, n in zip(got, names)]
    assert related(got, texts) > 1.5 * related(shuffled, texts)
