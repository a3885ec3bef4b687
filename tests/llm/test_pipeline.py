"""Each stage against a plain version, on what the stage before it kept."""

import re
from collections import Counter

import numpy as np
import pytest

from tests.llm.test_mixing import brute_targets
from tests.llm.test_near_dedup import brute as near_brute
from tests.llm.test_packing import check_sequences
from tests.llm.test_quality import brute

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def passes(text):
    n, chars, symbols, dup, rep = brute(text)
    text = text or ""
    lines = [x for x in text.split("\n") if WORD.search(x)]
    letters, upper = sum(c.isalpha() for c in text), sum(c.isupper() for c in text)
    lettered = sum(any(c.isalpha() for c in w) for w in WORD.findall(text))
    return not (n < 50 or 100 * rep > 50 * n or symbols * 10 > n or chars < 2 * n or chars > 12 * n or upper * 10 > letters * 3 or lettered * 10 < n * 7 or dup * 2 > len(lines))


def test_stages(spark, docs):
    pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    import corpus_pipeline as P
    from tessera.llm.common import materialize

    key = lambda r: (str(r["doc_id"]), r["text"] or "")
    states = [docs]
    for _, stage in P.STAGES:
        states.append(materialize(stage(spark, states[-1], "")))
    assert all(s.columns == docs.columns for s in states[:-1])
    start, good, lines, unique, mixed, packed = (s.collect() for s in states)

    assert sorted(map(key, good)) == sorted(key(r) for r in start if passes(r["text"])) and good

    pages, counts = Counter(r["source"] for r in good), Counter()
    for r in good:
        counts.update((r["source"], x) for x in set(r["text"].split("\n")) if WORD.search(x))
    bad = {k for k, n in counts.items() if n >= 5 and n > 0.1 * pages[k[0]]}
    assert sorted(map(key, lines)) == sorted((str(r["doc_id"]), "\n".join(x for x in r["text"].split("\n") if (r["source"], x) not in bad)) for r in good)
    assert all(r["n_chars"] == len(r["text"]) for r in lines)

    last = lambda d: (d is None, d or 0)
    least = near_brute([(last(r["doc_id"]), r["text"]) for r in lines])
    assert sorted(last(r["doc_id"]) for r in unique) == sorted({d for _, d in least})

    sizes = Counter()
    for r in unique:
        sizes[r["source"]] += len(WORD.findall(r["text"]))
    taken, most = Counter(), Counter(key(r) for r in mixed)
    for r in mixed:
        taken[r["source"]] += len(WORD.findall(r["text"]))
    largest = max(len(WORD.findall(r["text"])) for r in unique)
    for s, t in brute_targets(dict(sizes), (5, 2, 1), 3).items():
        assert abs(taken[s] - t) <= largest / 2 + 1
    assert max(most.values()) <= 3 and set(most) <= {key(r) for r in unique}

    assert check_sequences(packed, 4096) == 0
    tok = Tokenizer.from_file(P.tokenizer_path())
    want = Counter(str(r["doc_id"]) for r in mixed)
    tokens = {str(r["doc_id"]): len(tok.encode(r["text"], add_special_tokens=False).ids) + 1 for r in mixed}
    got = Counter()
    for r in packed:
        got[str(r["doc_id"])] += r["length"]
    assert got == Counter({d: n * tokens[d] for d, n in want.items()})
    assert np.all([r["doc_tokens"] == tokens[str(r["doc_id"])] for r in packed])


def test_empty_corpus(spark, empty):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline as P

    out = empty
    for _, stage in P.STAGES:
        out = stage(spark, out, "")
    assert out.count() == 0
