import random
import re

import numpy as np
import pyarrow as pa

from archivemill.llm import tokens


def test_words_are_those_of_the_pattern():
    pick = random.Random(4)
    texts = ["".join(pick.choice("aB é\n\t.-_9%\x0b\x0c\r ") for _ in range(pick.randrange(60))) for _ in range(300)]
    texts[5] = texts[17] = None
    spaced, alnum = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for inside, pattern, lower in ((tokens.SPACED, spaced, False), (tokens.ALNUM, alnum, True)):
        found, hashes = [], {}
        for part in tokens.slices(pa.array(texts, pa.string()).slice(3), 200):
            words = part.words(inside, lower)
            own = [[] for _ in range(len(part))]
            for owner, a, b, h in zip(words.owner, words.starts, words.ends, words.hashes, strict=True):
                word = bytes(part.data[a:b]).decode()
                word = word.translate({c: c + 32 for c in range(65, 91)}) if lower else word
                assert hashes.setdefault(word, h) == h
                own[owner].append(word)
            found += own
        low = {c: c + 32 for c in range(65, 91)}
        wanted = [pattern.findall((t or "").translate(low) if lower else t or "") for t in texts[3:]]
        assert found == wanted and len(set(hashes.values())) == len(hashes)


def test_windows_stay_in_their_text():
    part = next(tokens.slices(pa.array(["a b c", "d", "", "e f"])))
    at, grams = part.words().grams(2)
    assert at.tolist() == [0, 1, 4] and len(np.unique(grams)) == 3
    assert list(tokens.slices(pa.array([], pa.string()))) == []
