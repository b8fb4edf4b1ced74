"""The license index against a scan of every offset."""

import random

from auditlake.llm import licenses


def every_offset(index, words):
    labels, best = set(), 0.0
    for t, own in enumerate(index.words):
        for offset in range(-len(own), len(words) + 1):
            agree = sum(index.weight[w] for p, w in enumerate(own) if 0 <= p + offset < len(words) and words[p + offset] == w) / index.total[t]
            near = b" " + b" ".join(words[max(0, offset - 2) : max(0, offset + len(own) + 2)]) + b" "
            if agree > 0 and all(b" " + n + b" " in near for n in index.needed[t]):
                best = max(best, agree)
                if agree >= licenses.AGREE:
                    labels.add(licenses.TEMPLATES[t][0])
    return labels, best


def test_text_with_all_templates():
    rng = random.Random(3)
    vocabulary = sorted(licenses.VOCABULARY)
    for _ in range(5):
        index = licenses.TemplateIndex({w: rng.uniform(0.1, 9) for w in vocabulary})
        words = []
        for own in index.words:
            words += [b"filler"] * rng.randrange(4) + own
        assert index.scan(words) == every_offset(index, words)
        assert index.scan(words)[0] == {label for label, _, _ in licenses.TEMPLATES}


def test_partial_and_broken_templates():
    rng = random.Random(4)
    vocabulary = sorted(licenses.VOCABULARY)
    below = 0
    for _ in range(150):
        index = licenses.TemplateIndex({w: rng.uniform(0.1, 9) for w in vocabulary if rng.random() < 0.9})
        words = []
        for own in rng.sample(index.words, 3):
            part = own[rng.randrange(len(own) // 2) :]
            words += [w if rng.random() < 0.95 else b"other" for w in part] + [rng.choice(vocabulary) for _ in range(rng.randrange(60))]
        labels, best = index.scan(words)
        assert (labels, best) == every_offset(index, words)
        below += 0 < best < licenses.AGREE
    assert below > 5
