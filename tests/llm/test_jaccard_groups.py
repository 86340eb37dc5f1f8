"""Large buckets of near copies: linked by a pivot instead of split."""

import random

from strikeline.llm import jaccard


def test_near_copies_are_linked_by_a_pivot(spark, monkeypatch):
    """400 near copies and others that share a passage with them: links and classes as by brute force, and no more rows than members of buckets."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    texts = []
    for k in range(400):
        words = list(base)
        for _ in range(rng.randrange(1, 4)):
            words[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    texts += [" ".join(base[:30] + [f"y{rng.randrange(10**6)}" for _ in range(60)]) for _ in range(60)]
    seen, plain = [], jaccard._buckets

    def watched(*args):
        seen.append(plain(*args))
        return seen[-1]

    monkeypatch.setattr(jaccard, "_buckets", watched)
    found = {r.doc_id: r for r in jaccard.similar_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    for k, a in enumerate(sets):
        assert found[k].n_links == sum(len(a & b) >= 0.8 * len(a | b) for j, b in enumerate(sets) if j != k), k
    label = list(range(len(sets)))
    for k, a in enumerate(sets):
        for j in range(k):
            if len(a & sets[j]) >= 0.8 * len(a | sets[j]):
                low, high = sorted((label[k], label[j]))
                label = [low if x == high else x for x in label]
    assert [found[k].class_id for k in range(len(sets))] == label
    buckets, links = seen[0]
    first = jaccard.runs_needed() * jaccard.PER_RUN  # buckets of a set at the first level, about
    assert links.count() > 0 and buckets.count() <= 2 * first * len(sets)
