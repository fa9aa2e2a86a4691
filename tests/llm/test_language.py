import math
from collections import Counter

from conftest import awkward_rows

from gaugewright.llm import language
from gaugewright.llm.common import spaced_words


def brute(train):
    """The model's formula over plain counters; texts as word lists with their end."""
    texts = [[*spaced_words(t), "end"] for t in train]
    words, pairs = Counter(), Counter()
    for x in texts:
        words.update(x)
        pairs.update(zip(["first", *x[:-1]], x, strict=True))
    total, kinds = Counter(words), Counter(w for _, w in pairs)
    total["first"] = len(texts)

    def cuts(c):
        return language.cuts([sum(v == k for v in c.values()) for k in (1, 2, 3, 4)])

    two, one = cuts(pairs), cuts(kinds)
    cut = lambda n, d: d[min(n, 3) - 1] if n else 0
    left = Counter()
    for (h, _), n in pairs.items():
        left[h] += cut(n, two)
    everything = sum(kinds.values())
    rest = sum(cut(n, one) for n in kinds.values()) / everything if everything else 1.0

    def alone(w):
        return (kinds[w] - cut(kinds[w], one)) / max(1, everything) + rest / (len(words) + 1)

    def p(h, w):
        if h == "end" or not total[h]:
            return alone(w)
        n = pairs[h, w]
        return (n - cut(n, two)) / total[h] + left[h] / total[h] * alone(w)

    n, v = sum(words.values()), len(words)
    base = lambda w: math.log10((words[w] + 0.5) / (n + 0.5 * (v + 1)))
    return p, base, words, n


def test_scores_like_plain_counters(awkward):
    train = awkward.filter("doc_id is null or doc_id % 3 <> 0")
    model = language.train(train)
    p, base, words, n = brute([r["text"] for r in train.collect()])
    assert model.tokens == n and model.words == len(words)
    for r in language.score(awkward, model).collect():
        x = [*spaced_words(r["text"]), "end"]
        assert r["n_tokens"] == len(x) and r["n_known"] == sum(words[w] > 0 for w in x)
        assert math.isclose(r["base_score"], sum(map(base, x)), rel_tol=1e-9)
        assert math.isclose(r["score"], sum(math.log10(p(h, w)) for h, w in zip(["first", *x[:-1]], x, strict=True)), rel_tol=1e-5)


def test_probabilities_sum_to_one():
    p, _, words, _ = brute([t for _, t in awkward_rows()])
    for h in ("first", b"w1", b"unseen"):
        assert math.isclose(sum(p(h, w) for w in words) + p(h, b"never seen"), 1.0, rel_tol=1e-9)


def test_nothing_to_learn_from(none, awkward, clashing):
    model = language.train(none)
    rows = language.score(awkward, model).collect()
    assert all(r["score"] == 0 and r["n_known"] == 0 for r in rows) and language.score(none, model).count() == 0
    assert language.score(clashing, model).columns.count("score") == 1


def test_numbers_survive_packing():
    import numpy as np

    for values in (np.array([], np.uint32), np.array([0, 1, 2**32 - 1], np.uint32), np.array([2**63, 5], np.uint64), np.array([-4, 7])):
        assert (language.unsqueeze(language.squeeze(values)) == values).all()
