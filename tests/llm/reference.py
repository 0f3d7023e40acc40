"""Plain Python versions of what the operators compute, for small tables."""

import zlib

import numpy as np


def crc_of(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def encoded(texts, path, end_id=2):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return [e.ids + [end_id] for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def shingle_set(text, width):
    words = [w for w in (text or "").encode().lower().split()]
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else ({tuple(words)} if words else set())


def components_of(rows, width, percent):
    """{doc_id: (set size, smallest reachable id)} over (doc_id, text), by comparing every pair that shares a shingle."""
    from collections import Counter, defaultdict

    sets = {d: shingle_set(t, width) for d, t in rows}
    holders = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            holders[x].append(d)
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for d, s in sets.items():
        shared = Counter(o for x in s for o in holders[x] if o > d)
        for o, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[o]) - n):
                a, b = sorted((root(d), root(o)))
                parent[b] = a
    return {d: (len(s), root(d)) for d, s in sets.items()}


def base_statistics(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    import re
    from collections import Counter

    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = list(zip(words, words[1:], words[2:]))
    count = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(3)}
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed
