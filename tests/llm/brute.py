"""Plain Python versions of the operators, for comparison on small tables."""

import re

PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def pii_spans(text):
    out = []
    for kind, pattern in PII.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if (
                kind == "email"
                or (kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")))
                or (kind == "card" and 16 <= len(digits) <= 19 and luhn(digits))
                or (kind == "phone" and 8 <= len(digits) <= 15)
            ):
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


SECRET = r"(?<![0-9A-Za-z])(?:AKIA[0-9A-Z]{16}|(?=[0-9]*[A-Fa-f])(?=[A-Fa-f]*[0-9])[0-9A-Fa-f]{16,})(?![0-9A-Za-z])"
KINDS = (*PII, "secret")


def _contexts(text, begin, end, left, right):
    """(start, end, string, word, head, patterns, words around) of a find, as the operator sees it."""
    found = text[begin:end]
    lead = re.match(r"[^0-9A-Za-z(+]*", found)[0]
    tail = re.search(r"[^0-9A-Za-z)]*$", found)[0]
    core = found[len(lead) : len(found) - len(tail)]
    before, after = (text[max(left, begin - 48) : begin] + lead).lower(), (tail + text[end : min(right, end + 48)]).lower()
    letters = r"[^\W\d_]+"
    m = re.search(rf"({letters})([\W\d_]{{0,12}})$", before)
    words = re.findall(letters, before + " " + after)
    if not m:
        return begin + len(lead), end - len(tail), core, None, None, (), words
    head = (m[1], re.sub(r"\s+", " ", m[2]))
    further, then = re.search(rf"({letters})[\W\d_]+{letters}[\W\d_]{{0,12}}$", before), re.match(rf"[\W\d_]{{0,12}}({letters})", after)
    mixed = r"(?<![0-9A-Za-z])(?=[0-9]*[A-Za-z])(?=[A-Za-z]*[0-9])[0-9A-Za-z]{8,}"
    shape = re.sub("[A-Za-z]+", "a", re.sub("[0-9]", "0", re.sub(mixed, "*", core)))
    patterns = [(1, head, shape)] + [(k, head, x[1]) for k, x in ((2, then), (3, further)) if x]
    return begin + len(lead), end - len(tail), core, m[1], head, patterns, words


def pii_added(rows, min_score=0.75, min_support=5.0, telling=0.25):
    """rows: (doc_id, text). doc_id -> the spans (kind, start, end) of credentials and of what contexts add, by plain loops."""
    finds, out = [], {}
    for i, text in rows:
        found = [(KINDS.index(k), int(a), int(b)) for k, a, b in (x.split(":") for x in pii_spans(text).split(",") if x)]
        found += [(4, m.start(), m.end()) for m in re.finditer(SECRET, text)]
        out[i] = {f for f in found if f[0] == 4}
        rest = list(text)
        for _, a, b in found:
            rest[a:b] = "\ue000" * (b - a)
        rest = "".join(rest)
        apart = r"\s=\"'<>|;,\ue000"
        instance = rf"[0-9@][^{apart}]*(?:\x20[().+-]{{0,3}}[0-9][().+0-9-]{{0,24}}(?![^{apart}])){{0,7}}"
        for kind in range(5):
            here = [f for f in found if f[0] == kind]
            every = sorted((m.start(), m.end()) for m in re.finditer(SECRET if kind == 4 else PII[KINDS[kind]], text) if kind != 2 or 16 <= len(re.sub("[^0-9]", "", m[0])) <= 19)
            for _, a, b in here:
                finds.append((i, kind, *_contexts(text, a, b, max([e for _, e in every if e <= a], default=0), min([s for s, _ in every if s >= b], default=len(text)))))
        spots = [(m.start(), m.end()) for m in re.finditer(instance, rest)]
        for k, (a, b) in enumerate(spots):
            left, right = spots[k - 1][1] if k else 0, spots[k + 1][0] if k + 1 < len(spots) else len(text)
            a -= len(re.search(rf"[^{apart}]*$", rest[max(left, a - 48) : a])[0])
            got = _contexts(rest, a, b, left, right)
            if 6 <= len(re.sub("[^0-9A-Za-z]", "", got[2])) <= 64:
                finds.append((i, None, *got))
    right, around = {}, {}
    for f in finds:
        right[f[5]] = right.get(f[5], 0) + 1
        for w in f[8]:
            around[w] = around.get(w, 0) + 1
    edges = {}
    for _, kind, _, _, what, word, head, patterns, _ in finds:
        if head and right[word] >= telling * around[word]:
            for p in patterns:
                old = edges.get((what.lower(), head, p))
                edges[what.lower(), head, p] = kind if old is None else old if kind is None else max(old, kind)
    score, extra = {}, {}
    for _ in range(12):
        support, n = {}, {}
        for (what, _, p), kind in edges.items():
            n[p] = n.get(p, 0) + 1
            for k in range(5):
                f = float(kind == k) if kind is not None else extra.get((what, p, k), 0.0)
                support[p, k] = support.get((p, k), 0.0) + f
        new = {(p, k): s / n[p] for (p, k), s in support.items() if s}
        if score and max(v - score.get(x, 0.0) for x, v in new.items()) <= 1e-3:
            score = new
            break
        score, best = new, {}
        for (what, head, p), kind in edges.items():
            for k in range(5):
                if kind is None and support.get((p, k), 0) >= min_support:
                    best.setdefault((what, k), {}).setdefault(head, 0.0)
                    best[what, k][head] = max(best[what, k][head], score[p, k])
        extra = {}
        for (what, head, p), kind in edges.items():
            for k in range(5):
                if kind is None and (what, k) in best:
                    miss = 1.0
                    for h, v in best[what, k].items():
                        miss *= 1 - 0.9 * v if h != head else 1
                    extra[what, p, k] = 1 - miss
    for i, kind, start, end, _, _, _, patterns, _ in finds:
        said = [(score[p, k], -k) for p in patterns for k in range(5) if kind is None and score.get((p, k), 0) >= min_score and support.get((p, k), 0) >= min_support]
        if said:
            out[i].add((-max(said)[1], start, end))
    return {i: sorted(x) for i, x in out.items()}


def keys_of(text):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return [line.strip(" \t\n\x0b\x0c\r").translate(lower) for line in text.split("\n")]


def dropped_lines(rows):
    """rows: (doc_id, text). The kept text of each row, by the rule of three documents and the largest doc_id."""
    holders = {}
    for doc_id, text in rows:
        for key in set(keys_of(text or "")):
            if len(key) >= 20:
                holders.setdefault(key, set()).add(doc_id)
    out = []
    for doc_id, text in rows:
        lines, keys = (text or "").split("\n"), keys_of(text or "")
        gone = [len(h := holders.get(k, set()) - {None}) >= 3 and doc_id != max(h) for k in keys]
        out.append((doc_id, len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone) if not g)))
    return out


def quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = {}
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(3)}
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def components(nodes, links):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def redacted(text, spans):
    out, at = "", 0
    for start, end, kind in sorted(spans, key=lambda s: (s[0], s[1], KINDS.index(s[2]))):
        if start >= at:
            out += text[at:start] + f"[{kind.upper()}]"
        at = max(at, end)
    return out + text[at:]
