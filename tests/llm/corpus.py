"""A small corpus with copies, near copies, shared passages, repeats and odd texts."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows(seed=1, n=60):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéñ") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    words = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    passage, line = words(70), words(9)
    texts = []
    for _ in range(n):
        w = words(rng.randint(1, 220))
        if rng.random() < 0.3:
            w[len(w) // 2 : len(w) // 2] = passage[rng.randint(0, 15) :]
        if rng.random() < 0.5:
            w = line + w
        texts.append(rng.choice([" ", "  ", "\n"]).join(w))
    base = words(160)
    for k in range(12):  # near copies of one text
        w = list(base)
        for _ in range(k % 5):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        texts.append(" ".join(w))
    texts += [texts[3]] * 4 + [texts[5].replace(" ", "\n")]
    texts += ["ab" * 200, "x" * 350, "aa " * 150, "", None, "one", "ONE", "One two", " \n\t", "Ünïcödé 🙂 " * 30, "z" * 99, "z" * 100]
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(7 * i + 3, texts[k], "en", f"src{i % 3}", len(texts[k] or "")) for i, k in enumerate(order)]
