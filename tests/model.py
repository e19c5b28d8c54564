"""Brute-force models the tests compare with; written for clarity, not speed."""

SF = "/root/testdata/sf0.001"


def find(patterns, text):
    """Matches (start, end, id): earliest end, then longest, then lowest id."""
    found, last = [], 0
    for end in range(1, len(text) + 1):
        for start in range(last, end):
            hits = [i for i, p in enumerate(patterns) if text[start:end] == p]
            if hits:
                found.append((start, end, hits[0]))
                last = end
                break
    return found


def redact(patterns, text, token):
    out, last = text[:0], 0
    for start, end, i in find(patterns, text):
        out += text[last:start] + (token[i] if isinstance(token, list) else token)
        last = end
    return out + text[last:]


def live(patterns):
    keep = []
    for i, p in enumerate(patterns):
        if p in patterns[:i]:
            continue
        if any(q in p[:-1] for q in patterns):
            continue
        keep.append(i)
    return keep


def utf8_state(data):
    try:
        data.decode("utf-8")
        return "valid"
    except UnicodeDecodeError as e:
        # CPython reports a truncated but so far well-formed end this way.
        if e.reason == "unexpected end of data" and not data[e.start:] in (b"\xed\xa0", b"\xed\xbf"):
            return "incomplete"
        return "invalid"


def stream(patterns, chunks, token, complete=True):
    """Rows (seq, sent, status) of a stream, holding back whatever may become a match."""
    prefixes = {p[:i] for p in (patterns[k] for k in live(patterns)) for i in range(1, len(p))}
    out, held = [], b""
    for seq, chunk in enumerate(chunks):
        source = held + chunk
        state = utf8_state(source)
        if state == "invalid":
            return out + [(seq, b"", "invalid_utf8")]
        last = max([e for _, e, _ in find(patterns, source)], default=0)
        tail = 0
        while utf8_state(source[:len(source) - tail]) != "valid":
            tail += 1
        keep = max(
            [tail] + [n for n in range(1, len(source) - last + 1) if source[len(source) - n:] in prefixes]
        )
        end = complete and seq == len(chunks) - 1
        if end and not tail:
            keep = 0
        cut = len(source) - keep
        status = "open" if not end else "rejected_at_end" if tail else "completed"
        out.append((seq, redact(patterns, source[:cut], token), status))
        held = source[cut:]
    return out


def boundary(patterns, text):
    """How many bytes of a text the hold-back rule keeps."""
    longest = max(map(len, patterns))
    if longest <= 1:
        return 0
    if len(text) <= longest:
        return len(text)
    return max(
        (n for p in patterns for n in range(1, len(p)) if text.endswith(p[:n])), default=0
    )


def held_sizes(patterns, chunks):
    sizes, held = [], b""
    for chunk in chunks:
        if chunk:
            source = held + chunk
            if utf8_state(source) == "invalid":
                break
            tail = 0
            while utf8_state(source[:len(source) - tail]) != "valid":
                tail += 1
            text = source[:len(source) - tail]
            held = source[len(text) - boundary(patterns, text):]
        sizes.append(len(held))
    return sizes
