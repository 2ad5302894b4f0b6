"""Plain versions of the operators' contracts, a row or a pair at a time."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import xxhash

KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def personal(text):
    spans = []
    for kind, pattern in KINDS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": lambda: True,
                "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")),
                "card": lambda: 13 <= len(digits) <= 19 and luhn(digits),
                "phone": lambda: 9 <= len(digits) <= 15,
            }[kind]()
            if ok:
                spans.append((kind, m.start(), m.end()))
    return spans


def repeats(rows, length=50):
    """rows: (doc_id, text) to (doc_id, n_bytes, n_removed, n_spans, kept_sha256)."""
    first = {}
    for doc, text in rows:
        data = (text or "").encode()
        if doc is not None:
            for i in range(len(data) - length + 1):
                s = data[i : i + length]
                first[s] = min(first.get(s, doc), doc)
    out = []
    for doc, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        if doc is not None:
            for i in range(len(data) - length + 1):
                if first[data[i : i + length]] < doc:
                    gone[i : i + length] = b"\1" * length
        spans = len(re.findall(b"\1+", bytes(gone)))
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out.append((doc, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def contaminated(rows, items, window=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for item, text in items:
        w = word.findall(lower(text))
        if w:
            for i in range(max(0, len(w) - window) + 1):
                windows[tuple(w[i : i + window])].add(str(item))
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in rows:
        w, hit, found = word.findall(lower(text)), set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                t = tuple(w[i : i + size])
                if t in windows:
                    hit.update(range(i, i + size))
                    found |= windows[t]
        out.append((doc, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(rows, bits=2):
    """(fingerprint, a name of its component) of each row."""
    prints = [fingerprint(t) for _, t in rows]
    distinct = sorted(set(prints))
    root = {p: p for p in distinct}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= bits:
                root[find(a)] = find(b)
    return [(p, find(p)) for p in prints]


def components(rows, bits=2):
    """rows: (doc_id, text) to (doc_id, fingerprint, component_id)."""
    least = {}
    prints = linked(rows, bits)
    for (doc, _), (_, root) in zip(rows, prints):
        if doc is not None:
            least[root] = min(least.get(root, doc), doc)
    return [(doc, f"{p:016x}", least.get(root)) for (doc, _), (p, root) in zip(rows, prints)]


def tokens(tokenizer, rows, end_id):
    """rows in order to (doc_id, start, n_tokens, ids_crc32)."""
    out, start = [], 0
    for doc, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [end_id]
        out.append((doc, start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        start += len(ids)
    return out


def url_verdict(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = lower(re.split("[/?#]", rest, maxsplit=1)[0])
        path = re.split("[?#]", rest[len(host):], maxsplit=1)[0]
    best = max(
        (r for r in rules
         if host and (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])),
        key=lambda r: len(r[0] + r[1]), default=None)
    return host, path, best and best[0] + best[1], best[2] if best else "allow"


def divergence(rows, least=10, top=10):
    """rows: (text, lang, source) to (lang, source, part, item, value, rank)."""
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    docs, said = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        words = term.findall(lower(text))
        said[lang or "", source or ""].update(words)
        docs[lang or ""].update(set(words))
    out = []
    far = lambda a, b: (a - b) ** 2 // (a + b)
    for lang in {lang for lang, _ in said}:
        kept = [t for t, n in docs[lang].items() if n >= least]

        def shares(counts, kept=kept):
            total = sum(counts[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (counts[t] + 2) // total for t in kept}

        counts = {s: c for (lg, s), c in said.items() if lg == lang}
        p = {s: shares(c) for s, c in counts.items()}
        q = shares(sum(counts.values(), Counter()))
        for s, c in counts.items():
            pairs = [(-sum(far(p[s][t], p[o][t]) for t in kept), o.encode()) for o in counts if o != s]
            terms = [(-far(p[s][t], q[t]), t.encode()) for t in kept if c[t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, i.decode(), -v, n) for n, (v, i) in enumerate(found, 1)]
    return out


def hard_negatives(rows, anchors, wanted=5):
    """rows: distinct (id, label, whole-numbered vector) to rows as the operator gives them."""
    out = []
    for a, label, v in rows:
        if not anchors(a):
            continue
        near = sorted((-sum(x * y for x, y in zip(v, w)), i, other) for i, other, w in rows
                      if (i, other, w) != (a, label, v))
        for p, i, _ in [n for n in near if n[2] == label][:wanted]:
            found = [n for n in near if n[2] != label and -80 * p <= -100 * n[0] <= -100 * p][:wanted]
            out += [(a, i, rank, n[1], -p, -n[0]) for rank, n in enumerate(found, 1)]
    return out


def ngrams(text, sizes=(3, 4)):
    """Every n-gram of a text's letters, everything else being one space."""
    low = (text or "").lower()
    words = " ".join("".join(c if c.isalpha() else " " for c in low).split())
    words = f" {words} " if words else ""
    return [words[i : i + n] for n in sizes for i in range(len(words) - n + 1)]


def window_savings(text, ordinary, beyond, size=96):
    """Bytes that a dictionary of toxic words saves for each window, by one-shot compression."""
    import zstandard

    from millrace.llm import toxicity as X

    words = []
    long = [w.encode() for w in lower(text).split()]
    for w in long:
        words += [w] if max(map(len, long)) <= size else [
            w[i : i + size] for i in range(0, max(1, len(w) - size // 2), size // 2)]
    parts, held = [], []
    for w in words:
        if held and len(b" ".join(held)) + 1 + len(w) > size:
            parts.append(held)
            held = []
        held = [*held, w]
    parts = [*parts, held] if held else parts

    def length(window, content):
        settings = zstandard.ZstdCompressionParameters(
            window_log=17, hash_log=17, chain_log=16, search_log=1, min_match=5, target_length=1,
            strategy=zstandard.STRATEGY_FAST, write_content_size=False, write_checksum=False, write_dict_id=False)
        known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return len(zstandard.ZstdCompressor(dict_data=known, compression_params=settings).compress(window))

    out = []
    for part in parts:
        window = X.BALLAST + b" " + b" ".join(part) + b" "
        both = beyond + b"\n" * (-len(beyond) % 24) + ordinary + X.BALLAST
        out.append(length(window, ordinary + X.BALLAST) - length(window, both))
    return out
