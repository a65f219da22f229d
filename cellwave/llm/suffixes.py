"""Byte windows that share an anchor, and a suffix sort that compares by hashes."""

from __future__ import annotations

import numpy as np

from cellwave.llm.shingles import BASE, U64, mix, powers, prefix_hashes, span_hashes

#: Windows that are looked at together; their places fit in PLACE bits.
BLOCK, PLACE = 1 << 21, 22


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of ``width`` values."""
    least, have = values, 1
    while have * 2 <= width:
        least, have = np.minimum(least[:-have], least[have:]), have * 2
    rest = width - have
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def anchors(offsets: np.ndarray, data: np.ndarray, length: int, gram: int) -> dict[str, np.ndarray]:
    """Runs of windows of ``length`` bytes that have their anchor in common.

    A window's anchor is the gram of ``gram`` bytes in it with the least hash,
    the first of equals, so equal windows have equal anchors at equal places.
    Windows do not cross texts; texts of any length are taken BLOCK windows at
    a time, where a run may end. Returns, for each run: text (number), first and
    last (starts of its windows, in the text), at (place of the anchor less
    first), key (hash of the anchor), cls (hash of all the run's bytes and at).
    """
    blocks = [block_anchors(offsets, data, start, length, gram) for start in range(0, max(1, len(data)), BLOCK)]
    return {k: np.concatenate([b[k] for b in blocks]) for k in blocks[0]}


def block_anchors(offsets: np.ndarray, data: np.ndarray, start: int, length: int, gram: int) -> dict[str, np.ndarray]:
    """Those of the windows that begin within BLOCK bytes of ``start``."""
    empty = {k: np.zeros(0, np.int64) for k in ("text", "first", "last", "at", "key", "cls")}
    data = data[start : start + BLOCK + length - 1]
    n = len(data)
    if n < length:
        return empty
    sums = prefix_hashes(data)
    starts = np.arange(n - gram + 1)
    grams = mix(span_hashes(sums, starts, starts + gram))
    low = U64((1 << PLACE) - 1)
    places = sliding_least((grams & ~low) | starts.astype(U64), length - gram + 1) & low
    window = np.arange(n - length + 1)
    text = np.searchsorted(offsets, window + start, side="right") - 1
    inside = window + start + length <= offsets[text + 1]
    window, places, text = window[inside], places[inside].astype(np.int64), text[inside]
    if not len(window):
        return empty
    new = np.ones(len(window), bool)
    new[1:] = (places[1:] != places[:-1]) | (window[1:] != window[:-1] + 1) | (text[1:] != text[:-1])
    first = window[new]
    last = np.append(window[np.flatnonzero(new)[1:] - 1], window[-1])
    place, text = places[new], text[new]
    whole = span_hashes(sums, first, last + length)
    cls = mix(whole + mix((((place - first) << 20) + last - first).astype(U64)))
    begin = offsets[text] - start
    return {"text": text, "first": first - begin, "last": last - begin, "at": place - first, "key": grams[place].view(np.int64), "cls": cls.view(np.int64)}


def extension(sums: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Length, up to ``most``, of the common beginning of the suffixes at ``a`` and ``b``: binary search over prefix hashes."""
    power = powers(BASE, len(sums))
    up_a, up_b, zero_a, zero_b = power[a], power[b], sums[a], sums[b]
    found = np.zeros(len(a), np.int64)
    step = 1 << (most.bit_length() - 1)
    while step:
        longer = found + step
        fits = longer <= most
        same = fits.copy()
        x, y, t = a[fits], b[fits], longer[fits]
        same[fits] = (sums[x + t] - zero_a[fits]) * up_b[fits] == (sums[y + t] - zero_b[fits]) * up_a[fits]
        found = np.where(same, longer, found)
        step >>= 1
    return found


def suffix_order(data: np.ndarray, sums: np.ndarray, starts: np.ndarray, group: np.ndarray, most: int) -> np.ndarray:
    """A stable order of the suffixes of each group by their first ``most`` bytes.

    ``group`` is sorted; the suffixes of a group stay together. A mergesort in
    which all groups and all pairs of runs merge at once: a suffix finds its
    place in the neighbouring run by binary search, and two suffixes compare by
    the byte after their common beginning.
    """
    n = len(starts)
    order = np.arange(n)
    if n < 2:
        return order
    head = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    sizes = np.diff(np.append(head, n))
    begin, size = np.repeat(head, sizes), np.repeat(sizes, sizes)
    width = 1
    while width < sizes.max():
        at = np.flatnonzero(size > width)
        base, total = begin[at], size[at]
        inner = at - base
        run = inner // width
        left = run % 2 == 0
        low = base + np.minimum(np.where(left, run + 1, run - 1) * width, total)
        high = base + np.minimum(np.where(left, run + 1, run - 1) * width + width, total)
        mine, first = starts[order[at]], low.copy()
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            middle = (low[open_] + high[open_]) >> 1
            a, b = mine[open_], starts[order[middle]]
            same = extension(sums, a, b, most)
            ended = same >= most
            next_a, next_b = data[np.where(ended, 0, a + same)], data[np.where(ended, 0, b + same)]
            # suffixes of a left run go before equal ones of the right run
            before = np.where(ended, ~left[open_], next_b < next_a)
            low[open_] = np.where(before, middle + 1, low[open_])
            high[open_] = np.where(before, high[open_], middle)
        place = base + (run - run % 2) * width + inner % width + (low - first)
        merged = order.copy()
        merged[place] = order[at]
        order = merged
        width *= 2
    return order


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: int, step: int = 1 << 15) -> np.ndarray:
    """Whether data[a : a + length] and data[b : b + length] are the same bytes."""
    span, out = np.arange(length), np.zeros(len(a), bool)
    for i in range(0, len(a), step):
        out[i : i + step] = (data[a[i : i + step, None] + span] == data[b[i : i + step, None] + span]).all(1)
    return out


def same_spans(data: np.ndarray, a: np.ndarray, b: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether the bytes from ``a`` and from ``b`` on are the same, each pair over its own length."""
    raw = data.tobytes()
    return np.fromiter((raw[x : x + n] == raw[y : y + n] for x, y, n in zip(a.tolist(), b.tolist(), lengths.tolist())), bool, len(a))


def repeated_windows(data: np.ndarray, starts: np.ndarray, group: np.ndarray, length: int) -> np.ndarray:
    """For each window, whether one before it in its (sorted) group has the same ``length`` bytes."""
    sums = prefix_hashes(data)
    order = suffix_order(data, sums, starts, group, length)
    a, b = starts[order[:-1]], starts[order[1:]]
    near = (group[order[1:]] == group[order[:-1]]) & (extension(sums, a, b, length) >= length) if len(order) > 1 else np.zeros(0, bool)
    hit = np.flatnonzero(near)
    near[hit] = same_bytes(data, a[hit], b[hit], length)
    out = np.zeros(len(starts), bool)
    out[order[1:][near]] = True
    if (~near[hit]).any():  # a collision of hashes: its groups once more, byte by byte
        for g in np.unique(group[order[1:][hit[~near[hit]]]]):
            seen: set[bytes] = set()
            for i in np.flatnonzero(group == g):
                window = data[starts[i] : starts[i] + length].tobytes()
                out[i] = window in seen
                seen.add(window)
    return out
