"""Plain forms of the text operators, for small inputs."""

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def ascii_lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text, k=5):
    w = words(ascii_lower(text))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) or frozenset([tuple(w)])


def near_duplicates(rows, percent=75):
    """rows: (doc_id, text). {doc_id: (n_shingles, component)}"""
    sets = {d: shingles(t) for d, t in rows}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    owners = {}
    for d, s in sets.items():
        for x in s:
            owners.setdefault(x, []).append(d)
    tried = set()
    for d, s in sets.items():
        for other in {o for x in s for o in owners[x] if o > d}:
            if (d, other) in tried:
                continue
            tried.add((d, other))
            common = len(s & sets[other])
            if 100 * common >= percent * (len(s) + len(sets[other]) - common):
                a, b = sorted((root(d), root(other)))
                parent[b] = a
    return {d: (len(sets[d]), root(d)) for d in sets}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def substring_dedup(rows, k=35):
    """rows: (doc_id, text). {row number: (n_words, n_removed, kept_sha256)}"""
    seqs = [words(t) for _, t in rows]
    seen = {}
    for w in seqs:
        for i in range(len(w) - k + 1):
            key = tuple(w[i:i + k])
            seen[key] = seen.get(key, 0) + 1
    out = []
    for (d, _), w in zip(rows, seqs):
        gone = [False] * len(w)
        for i in range(len(w) - k + 1):
            if seen[tuple(w[i:i + k])] > 1:
                gone[i:i + k] = [True] * k
        out.append((d, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g))))
    return out


def _spans(found, kinds):
    return ",".join(f"{k}:{a}:{b}" for a, k, b in sorted(found, key=lambda s: (s[0], kinds.index(s[1]))))


PII_KINDS = ["email", "ip", "card", "phone", "term"]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def personal_data(text):
    text, out = text or "", []
    out += [(m.start(), "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), "ip", m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), "card", m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), "phone", m.end()))
    return _spans(out, PII_KINDS)


SECRET_KINDS = ["assign", "access", "hex", "random"]


def secrets(text):
    text, out = text or "", []
    for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.A):
        if len(m[2]) >= 6:
            out.append((m.start(), "assign", m.end()))
    out += [(m.start(), "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return _spans(out, SECRET_KINDS)


def line_runs(rows, min_chars=60):
    """rows: distinct (doc_id, text). [(doc_id, n_lines, n_removed, sha of what is kept)]; later copies of runs go."""
    split = [(d, t.split("\n") if t else []) for d, t in rows]
    ordered = sorted(split, key=lambda x: x[0])
    seen_two, seen_one, out = set(), set(), []
    for d, found in ordered:
        gone = [False] * len(found)
        for i, line in enumerate(found):
            if len(line.encode()) >= min_chars and line in seen_one:
                gone[i] = True
            seen_one.add(line)
        for i in range(len(found) - 1):
            pair = (found[i], found[i + 1])
            if pair in seen_two:
                gone[i] = gone[i + 1] = True
            seen_two.add(pair)
        out.append((d, len(found), sum(gone), sha("\n".join(x for x, g in zip(found, gone) if not g))))
    return out


def fold(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", ascii_lower(text))


def least_edits(pattern, text):
    """Fewest edits between a pattern and any part of a text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, x in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != x)))
        row = new
    return min(row)


def tokenizer_groups(rows, first, second):
    """rows: (doc_id, text). [(n_a, n_b, n_groups, n_links, n_best, count_sum, sha)] from the libraries' own encoders."""
    import sentencepiece
    import tokenizers

    a = tokenizers.Tokenizer.from_file(first)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=second)
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte_of = {chr(x): x for x in plain} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in plain)}
    found, held = [], {}
    for _, text in rows:
        groups, whole = [], (" " + text).encode() if text else b""
        ta, tb = a.encode(" " + text, add_special_tokens=False) if text else None, b.encode(text) if text else []
        ends, sides = [], []
        for ids, parts in ((ta.ids if text else [], [bytes(byte_of[c] for c in t) for t in ta.tokens] if text else []),
                           (tb, [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in tb])):
            sides.append((ids, b"".join(parts)))
            n, own = 0, []
            for p in parts:
                n += len(p)
                own.append(n)
            ends.append(own)
        if sides[0][1] == sides[1][1] == whole:
            i = j = 0
            for end in sorted(set(ends[0]) & set(ends[1])):
                group = [], []
                while i < len(ends[0]) and ends[0][i] <= end:
                    group[0].append(sides[0][0][i])
                    i += 1
                while j < len(ends[1]) and ends[1][j] <= end:
                    group[1].append(sides[1][0][j])
                    j += 1
                groups.append(group)
        links = [(x, y) for g in groups for x in g[0] for y in g[1]]
        for pair in set(links):
            held[pair] = held.get(pair, 0) + 1
        told = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        found.append((sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), links, sha(told) if groups else ""))
    top = {}
    for (x, _), n in held.items():
        top[x] = max(top.get(x, 0), n)
    return [(na, nb, ng, len(links), sum(held[p] == top[p[0]] for p in links), sum(held[p] for p in links), told) for na, nb, ng, links, told in found]


def spelling_variants(rows, least_chars=6, least_times=5, times_more=5, noise=199):
    """rows: (doc_id, text). {word: (form, root, n, n_near, form_n)} by comparing all words."""
    import zlib

    count = {}
    for d, text in rows:
        for word in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = ascii_lower(word)
            h = zlib.crc32(f"{'' if d is None else d}:{word}".encode())
            if h % noise == 0:
                word = word[:h % len(word)] + word[h % len(word) + 1:]
            count[word] = count.get(word, 0) + 1
    count = {w: n for w, n in count.items() if len(w) >= least_chars and n >= least_times}

    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(b) - len(a) > 1 or a == b:
            return False
        k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
        return a[k:] == b[k + 1:] or a[k + 1:] == b[k + 1:]
    close = {w: [v for v in count if near(w, v)] for w in count}
    form = {}
    for w, others in close.items():
        if others:
            best = min(others, key=lambda v: (-count[v], v))
            if count[best] >= times_more * count[w]:
                form[w] = best
    out = {}
    for w, n in count.items():
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n, len(close[w]), count[form[w]] if w in form else None)
    return out


def matching_scores(rows, order=4, fold=10):
    """rows: (doc_id, text). [(held_out, n_tokens, n_known, train_tokens, base, score)] from nested dictionaries of counts."""
    import math
    import zlib

    out_of = [d is not None and zlib.crc32(str(d).encode()) % fold == 0 for d, _ in rows]
    contexts, known = {}, {}
    for (_, text), out in zip(rows, out_of):
        if out:
            continue
        symbols = [*ascii_lower(text).encode(), 256]
        for i, s in enumerate(symbols):
            for k in range(min(i, order) + 1):
                row = contexts.setdefault(tuple(symbols[i - k:i]), {})
                row[s] = row.get(s, 0) + 1
        for w in words(ascii_lower(text)) + [" "]:
            known[w] = known.get(w, 0) + 1
    total = sum(known.values())
    unit, found = total + 0.1 * (len(known) + 1), []
    for (_, text), out in zip(rows, out_of):
        symbols, score = [*ascii_lower(text).encode(), 256], 0.0
        for i, s in enumerate(symbols):
            gone = set()
            for k in range(min(i, order), -1, -1):
                left = {x: n for x, n in contexts.get(tuple(symbols[i - k:i]), {}).items() if x not in gone}
                whole = sum(left.values()) + len(left)
                if s in left:
                    score += math.log10(left[s] / whole)
                    break
                if left:
                    score += math.log10(len(left) / whole)
                    gone |= set(left)
            else:
                score -= math.log10(257 - len(gone))
        tokens = words(ascii_lower(text)) + [" "]
        found.append((out, len(tokens), sum(w in known for w in tokens), total, sum(math.log10((known.get(w, 0) + 0.1) / unit) for w in tokens), score))
    return found
