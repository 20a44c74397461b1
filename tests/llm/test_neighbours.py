"""A text's toxicity score does not depend on the texts beside it."""

import numpy as np

from rallyframe.llm import toxicity as X


def model_of(rng):
    tables = [rng.normal(0, 1, (1 << bits, X.PART)).astype(np.float32) for bits in X.TABLE_BITS]
    for table in tables:
        table[0] = 0
    filters = [rng.normal(0, 1, (w, len(X.COLUMNS) * X.PART, X.FILTERS)).astype(np.float32) for w in X.WIDTHS]
    biases = [np.full(X.FILTERS, -0.1, np.float32) for _ in X.WIDTHS]
    return X.ConvModel(tables, filters, biases, rng.normal(0, 1, X.FILTERS * len(X.WIDTHS)).astype(np.float32), 0.0)


def padded_texts(texts):
    raw = [text.encode() for text in texts]
    words, rows = X.described(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    return X.padded(X.hashed(words), rows)


def test_a_text_scores_the_same_alone_and_between_any_neighbours():
    rng = np.random.default_rng(4)
    model = model_of(rng)
    texts = ["one", "", "two words", "three short words", "a clean and quiet text of several words", "x y z w v u"]
    alone = np.array([model.raw(*padded_texts([text]))[0] for text in texts])
    for _ in range(30):
        order = rng.permutation(len(texts))
        got = model.raw(*padded_texts([texts[k] for k in order]))
        assert np.allclose(got, alone[order], atol=1e-4)


def test_windows_of_largest_response_end_within_their_row():
    model = model_of(np.random.default_rng(5))
    places, bounds = padded_texts(["one", "two words", "", "three short words", "four"])
    _, spots = model.pooled(places, bounds, where=True)
    for width, at in zip(X.WIDTHS, spots):
        assert (at >= bounds[:-1, None]).all() and (at + width <= bounds[1:, None]).all()
