"""Two-stage suffix sorting of many short pieces at once, and which of their windows are equal."""

from __future__ import annotations

import numpy as np

PAD = 8  # zero bytes after each piece, so that an 8-byte word never reaches into the next one


def laid_out(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One array of all pieces, bytes raised by one (UTF-8 never holds 255), zeros after each; and where each starts."""
    sizes = np.array([len(p) for p in pieces], np.int64)
    starts = np.cumsum(sizes + PAD) - (sizes + PAD) + PAD
    data = np.frombuffer(bytes(PAD) + bytes(PAD).join(pieces) + bytes(PAD), np.uint8)
    text = np.zeros(len(data), np.uint8)
    inside = np.zeros(len(data) + 1, np.int8)
    np.add.at(inside, starts, 1)
    np.add.at(inside, starts + sizes, -1)
    at = np.cumsum(inside[:-1]).astype(bool)
    text[at] = data[at] + 1
    return text, starts


def words_at(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as a number whose order is theirs."""
    out = np.zeros(len(text), np.uint64)
    for k in range(8):
        out[: len(text) - k] |= text[k:].astype(np.uint64) << np.uint64(56 - 8 * k)
    return out


def rising(text: np.ndarray) -> np.ndarray:
    """Suffixes smaller than their successors. A run of one byte takes the side of the byte after it; zeros rise."""
    change = np.flatnonzero(text[1:] != text[:-1])
    run = np.zeros(len(text), np.int64)
    run[change + 1] = 1
    run = np.cumsum(run)
    side = np.concatenate((text[change] < text[change + 1], [True]))
    return side[run] | (text == 0)


def sorted_directly(words: np.ndarray, at: np.ndarray, most: int) -> np.ndarray:
    """The suffixes ``at`` in order of their first ``most`` bytes, by eight bytes more a round; only ties go on.

    Ties and equal rests of pieces keep their order of place.
    """
    order = at[np.argsort(words[at], kind="stable")]
    key = words[order]
    tied = np.concatenate(([False], key[1:] == key[:-1]))
    live, depth = np.arange(len(order)), 0
    group = np.cumsum(~tied)
    while depth + PAD < most:
        same = tied[live] | np.append(tied[live][1:], False)
        same &= words[order[live] + depth] & np.uint64(0xFF) != 0  # the piece has not ended
        live = live[same]
        if not len(live):
            break
        depth += PAD
        own, held = group[live], order[live]
        key = words[held + depth]
        by = np.argsort(key, kind="stable")
        by = by[np.argsort(own[by].astype(np.int32), kind="stable")]
        order[live], key = held[by], key[by]
        new = np.concatenate(([True], (own[1:] != own[:-1]) | (key[1:] != key[:-1])))
        tied[live] = ~new
        group[live] = np.cumsum(new)
    return order


def suffix_array(text: np.ndarray, words: np.ndarray, most: int = 1 << 62) -> np.ndarray:
    """All suffixes in order, ends of pieces by their place; with ``most`` in the order of that many first bytes.

    First stage: the rising suffixes are sorted directly. Second stage: the buckets of first bytes are scanned
    upwards; a falling suffix takes the next place at the head of its bucket when its successor is passed, and the
    rising ones of the bucket follow.
    """
    up = rising(text)
    zero = np.flatnonzero(text == 0)
    direct = sorted_directly(words, np.flatnonzero(up & (text > 0)), most)
    bounds = np.searchsorted(text[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = [zero]

    def pass_on(scanned: np.ndarray, byte: int) -> np.ndarray:
        """Hands falling predecessors to their buckets; returns those of this bucket."""
        before = scanned[scanned > 0] - 1
        before = before[~up[before]]
        first = text[before]
        far = before[first > byte]
        if len(far):
            far = far[np.argsort(text[far], kind="stable")]
            bytes_, cut = np.unique(text[far], return_index=True)
            for b, part in zip(bytes_, np.split(far, cut[1:])):
                waiting[b].append(part)
        return before[first == byte]

    pass_on(zero, 0)
    for byte in range(1, 256):
        falling = waiting[byte]
        newly = np.concatenate(falling) if falling else np.empty(0, np.int64)
        while len(newly):
            out.append(newly)
            newly = pass_on(newly, byte)
        risen = direct[bounds[byte] : bounds[byte + 1]]
        if len(risen):
            out.append(risen)
            pass_on(risen, byte)
        waiting[byte] = []
    return np.concatenate(out)


def equal_neighbours(words: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For each place in ``order``: does its suffix share ``length`` bytes or more with the one before it?"""
    out = np.zeros(len(order), bool)
    live = np.arange(1, len(order))
    for depth in range(0, length, 8):
        mask = np.uint64((1 << 64) - (1 << 8 * max(0, 8 - (length - depth))))
        a, b = order[live - 1] + depth, order[live] + depth
        inside = np.maximum(a, b) < len(words)
        live, a, b = live[inside], a[inside], b[inside]
        live = live[(words[a] ^ words[b]) & mask == 0]
    out[live] = True
    return out


def repeated_windows(pieces: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``piece, start, group`` of all windows of ``length`` bytes that stand at more than one place of the pieces.

    Windows of one group are equal, those of different groups are not.
    """
    text, starts = laid_out(pieces)
    words = words_at(text)
    order = suffix_array(text, words, length)
    sizes = np.array([len(p) for p in pieces], np.int64)
    owner = np.searchsorted(starts, order, "right") - 1
    whole = (owner >= 0) & (order - starts[owner] + length <= sizes[owner])
    order, owner = order[whole], owner[whole]
    same = equal_neighbours(words, order, length)
    group = np.cumsum(~same)
    shared = same | np.append(same[1:], False)
    return owner[shared], (order - starts[owner])[shared], group[shared]
