"""Personal data: rules for four kinds, and a character-level bidirectional LSTM with CRF transitions that adds spans.

The rules find e-mail addresses, IP addresses, payment cards and phone numbers in their usual forms. The tagger learns
from spans that the rules label in a bounded sample of texts, and from the same spans rewritten the ways people write
them ("name at mail dot com", a phone without its plus sign). Windows of a text overlap; each is decoded by itself and
the overlaps are reconciled over the whole text."""

from __future__ import annotations

import hashlib
import pickle
import random
import re
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderspark.llm.common import with_text_columns

#: Kinds in the order in which spans that start together are listed.
KINDS = ("email", "ip", "card", "phone")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match can only start where a run of digits does, so a long run is read once
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]+")

SPAN = "struct<kind:string,start:long,end:long>"


def luhn(digits: str) -> bool:
    """Whether the digits' check sum (every second one from the right doubled) is a multiple of ten."""
    odd, even = digits[::-1][::2], digits[::-1][1::2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _only_digits(text: str) -> str:
    return "".join(DIGITS.findall(text))


def _is_card(text: str) -> bool:
    digits = _only_digits(text)
    return 12 <= len(digits) <= 19 and luhn(digits)


def _emails(text: str) -> Iterable[tuple[int, int]]:
    """Matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, found from each at sign: linear in the text."""
    low, sign = 0, text.find("@")
    while sign >= 0:
        start = low + len(text[low:sign].rstrip(LOCAL))
        host = HOST.match(text, sign + 1) if start < sign else None
        if host:
            yield start, host.end()
        low = host.end() if host else sign + 1
        sign = text.find("@", low)


def rule_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, leftmost and non-overlapping for each kind, by start and then kind as listed.

    A match that fails its test (parts of an address over 255, digits that are too few, too many or of a wrong check
    sum) is dropped and not tried again from within."""
    out = []
    if "@" in text:
        out += [("email", *span) for span in _emails(text)]
    if DIGITS.search(text):
        out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]
        out += [("card", *m.span()) for m in CARD.finditer(text) if m.end() - m.start() >= 12 and _is_card(m[0])]
        if "+" in text:
            out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(_only_digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


# --- the tagger -------------------------------------------------------------------------------------------------------

#: Tags: outside, then begin and inside of each kind.
TAGS = 1 + 2 * len(KINDS)
#: What a character is to the tagger: printable ASCII each for itself, then other letters, other blanks, everything else.
SYMBOLS = 95 + 3
WINDOW, STRIDE = 128, 64
#: A window without any of these holds none of the tagger's spans (every span has one), so it need not be run.
TRIGGER = re.compile(r"[0-9@]+")
SPELLED = re.compile(r"[(\[](?:at|dot)[)\]]|\bdot\b", re.IGNORECASE)
PHONE_LIKE = re.compile(r"[0-9\x20().+/-]+")


def symbols(text: str) -> np.ndarray:
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    out = np.where((code >= 0x20) & (code < 0x7F), code.astype(np.int64) - 0x20, 97)
    out[code > 0xA0] = 95
    out[(code >= 9) & (code <= 13) | (code == 0xA0) | (code == 0x3000)] = 96
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _lstm(x: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, list]:
    """Hidden states (time, way, row, unit) of inputs `x` (time, way, row, feature), and what the way back needs.

    Both ways through a text are one array, the second one turned round, so that each step is one set of products."""
    steps, ways, rows, _ = x.shape
    units = u.shape[1]
    h, c = np.zeros((ways, rows, units), x.dtype), np.zeros((ways, rows, units), x.dtype)
    out, kept = np.empty((steps, ways, rows, units), x.dtype), []
    inputs = np.matmul(x, w) + b[:, None, :]
    for t in range(steps):
        z = inputs[t] + np.matmul(h, u)
        gates = _sigmoid(z[..., : 3 * units])
        i, f, o = gates[..., :units], gates[..., units : 2 * units], gates[..., 2 * units :]
        g = np.tanh(z[..., 3 * units :])
        before, last = c, h
        c = f * c + i * g
        tc = np.tanh(c)
        h = o * tc
        out[t] = h
        kept.append((i, f, o, g, before, last, tc))
    return out, kept


def _lstm_back(d_out: np.ndarray, x: np.ndarray, w: np.ndarray, u: np.ndarray, kept: list) -> tuple[np.ndarray, ...]:
    """Gradients of inputs, w, u and b, through time."""
    steps, ways, rows, units = d_out.shape
    dz = np.empty((steps, ways, rows, 4 * units), x.dtype)
    dh, dc = np.zeros((ways, rows, units), x.dtype), np.zeros((ways, rows, units), x.dtype)
    back = u.transpose(0, 2, 1)
    for t in range(steps - 1, -1, -1):
        i, f, o, g, before, last, tc = kept[t]
        dh = dh + d_out[t]
        dc = dc + dh * o * (1 - tc * tc)
        z = dz[t]
        z[..., :units] = dc * g * i * (1 - i)
        z[..., units : 2 * units] = dc * before * f * (1 - f)
        z[..., 2 * units : 3 * units] = dh * tc * o * (1 - o)
        z[..., 3 * units :] = dc * i * (1 - g * g)
        dh, dc = np.matmul(z, back), dc * f
    by_way = lambda a: a.transpose(1, 0, 2, 3).reshape(ways, steps * rows, -1)
    flat, last = by_way(dz), by_way(np.stack([k[5] for k in kept]))
    dw, du = np.matmul(by_way(x).transpose(0, 2, 1), flat), np.matmul(last.transpose(0, 2, 1), flat)
    return np.matmul(dz, w.transpose(0, 2, 1)), dw, du, flat.sum(1)


#: Transitions a CRF may take: an inside tag follows the begin or inside tag of its kind only.
ALLOWED = np.array([[b == 0 or b % 2 == 1 or a in (b, b - 1) for b in range(TAGS)] for a in range(TAGS)])
FORBIDDEN = -1e4


@dataclass
class Tagger:
    """Parameters by name: an embedding, two LSTMs, the emission layer and the CRF's transition scores."""

    p: dict[str, np.ndarray]

    @staticmethod
    def fresh(embedded: int = 12, units: int = 24, seed: int = 0) -> Tagger:
        r = np.random.default_rng(seed)
        p = {"e": r.normal(0, 0.3, (SYMBOLS + 1, embedded))}
        p["w"] = r.normal(0, embedded**-0.5, (2, embedded, 4 * units))
        p["u"] = r.normal(0, units**-0.5, (2, units, 4 * units))
        p["b"] = np.tile(np.concatenate([np.zeros(units), np.ones(units), np.zeros(2 * units)]), (2, 1))
        p["o"] = r.normal(0, (2 * units) ** -0.5, (2 * units, TAGS))
        p["ob"], p["t"], p["s"] = np.zeros(TAGS), np.zeros((TAGS, TAGS)), np.zeros(TAGS)
        return Tagger({k: v.astype(np.float32) for k, v in p.items()})

    def _emit(self, x: np.ndarray) -> tuple[np.ndarray, tuple]:
        p = self.p
        e = p["e"][x]
        e = np.stack([e, e[::-1]], 1)
        h, kept = _lstm(e, p["w"], p["u"], p["b"])
        both = np.concatenate([h[:, 0], h[::-1, 1]], 2)
        return both @ p["o"] + p["ob"], (e, kept, both)

    def _scores(self) -> tuple[np.ndarray, np.ndarray]:
        start = np.where([k == 0 or k % 2 == 1 for k in range(TAGS)], self.p["s"], FORBIDDEN)
        return np.where(ALLOWED, self.p["t"], FORBIDDEN), start

    def _marginals(self, emit: np.ndarray) -> tuple[np.ndarray, ...]:
        """Forward and backward sums, scaled to one at each step (their product is the CRF's marginal), the scaled
        emissions, the scales, and the logarithm of the sum over all taggings of each row."""
        move, start = self._scores()
        steps, rows, _ = emit.shape
        top = emit.max(2, keepdims=True)
        seen, way = np.exp(emit - top), np.exp(move)
        alpha, beta, scale = np.empty_like(emit), np.ones_like(emit), np.empty((steps, rows), emit.dtype)
        for t in range(steps):
            now = seen[t] * (alpha[t - 1] @ way if t else np.exp(start))
            scale[t] = now.sum(1)
            alpha[t] = now / scale[t][:, None]
        for t in range(steps - 2, -1, -1):
            beta[t] = (seen[t + 1] * beta[t + 1] / scale[t + 1][:, None]) @ way.T
        return alpha, beta, seen, scale, np.log(scale).sum(0) + top.sum((0, 2))

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of tags `y` (time, row) for symbols `x`, and its gradients.

        The CRF's marginals come from forward and backward sums; they minus the given tags go back through the LSTMs."""
        p = self.p
        emit, (e, kept, both) = self._emit(x)
        move, start = self._scores()
        steps, rows = x.shape
        alpha, beta, seen, scale, total = self._marginals(emit)
        d_emit = alpha * beta
        d_start = d_emit[0].sum(0)
        d_move = np.exp(move) * (alpha[:-1].reshape(-1, TAGS).T @ (seen * beta / scale[:, :, None])[1:].reshape(-1, TAGS))
        row = np.arange(rows)
        gold = start[y[0]] + np.take_along_axis(emit, y[:, :, None], 2).sum((0, 2)) + move[y[:-1], y[1:]].sum(0)
        np.add.at(d_move, (y[:-1].ravel(), y[1:].ravel()), -1)
        np.add.at(d_start, y[0], -1)
        for t in range(steps):
            d_emit[t, row, y[t]] -= 1
        n = steps * rows
        d_emit, d_move, d_start = d_emit / n, d_move / n * ALLOWED, d_start / n
        units = p["u"].shape[1]
        d_both = d_emit @ p["o"].T
        d_h = np.stack([d_both[..., :units], d_both[::-1, :, units:]], 1)
        d_x, d_w, d_u, d_b = _lstm_back(d_h, e, p["w"], p["u"], kept)
        d_e = np.zeros_like(p["e"])
        np.add.at(d_e, x, d_x[:, 0] + d_x[::-1, 1])
        flat = d_emit.reshape(-1, TAGS)
        return float((total - gold).sum() / n), {
            "e": d_e, "w": d_w, "u": d_u, "b": d_b,
            "o": both.reshape(-1, 2 * units).T @ flat, "ob": flat.sum(0), "t": d_move, "s": d_start,
        }

    def train(self, x: np.ndarray, y: np.ndarray, passes: int = 10, rows: int = 96, rate: float = 0.02, seed: int = 0) -> Tagger:
        """Adam steps over batches of windows (window, time), shuffled each pass; the rate falls linearly."""
        r = np.random.default_rng(seed)
        mean = {k: np.zeros_like(v) for k, v in self.p.items()}
        spread = {k: np.zeros_like(v) for k, v in self.p.items()}
        step, steps = 0, max(1, passes * -(-len(x) // rows))
        for _ in range(passes):
            order = r.permutation(len(x))
            for at in range(0, len(x), rows):
                pick = order[at : at + rows]
                _, grads = self.gradients(x[pick].T, y[pick].T)
                norm = float(np.sqrt(sum(float((g * g).sum()) for g in grads.values())))
                now = rate * (1 - step / steps) + 1e-4
                step += 1
                for k, g in grads.items():
                    g = g * min(1.0, 1 / max(norm, 1e-12))
                    mean[k] = 0.9 * mean[k] + 0.1 * g
                    spread[k] = 0.99 * spread[k] + 0.01 * g * g
                    self.p[k] -= (now * (mean[k] / (1 - 0.9**step)) / (np.sqrt(spread[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self

    def tags(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best tags (time, row) of symbols `x` by Viterbi, and the confidence of each: its CRF marginal."""
        emit, _ = self._emit(x)
        move, start = self._scores()
        alpha, beta, *_ = self._marginals(emit)
        steps, rows = x.shape
        best, came = emit[0] + start, np.zeros((steps, rows, TAGS), np.int8)
        for t in range(1, steps):
            ways = best[:, :, None] + move
            came[t] = ways.argmax(1)
            best = emit[t] + ways.max(1)
        row = np.arange(rows)
        out = np.empty((steps, rows), np.int8)
        out[-1] = best.argmax(1)
        for t in range(steps - 1, 0, -1):
            out[t - 1] = came[t][row, out[t]]
        return out, np.take_along_axis(alpha * beta, out[:, :, None].astype(np.int64), 2)[:, :, 0]


# --- windows ----------------------------------------------------------------------------------------------------------


def windows(text: str) -> list[int]:
    """Starts of the overlapping windows that cover the triggers of a whole text, each trigger in every window over it."""
    starts = set()
    lower = text.lower()
    spelled = SPELLED.finditer(text) if "dot" in lower or "at)" in lower or "at]" in lower else ()
    for found in (TRIGGER.finditer(text), spelled):
        for m in found:
            first = max(0, (m.start() - WINDOW) // STRIDE + 1)
            starts.update(range(first * STRIDE, m.end(), STRIDE))
    return sorted(starts)


def _filled(code: np.ndarray, at: int) -> np.ndarray:
    """The window's symbols, padded by a symbol of its own where the text ends."""
    part = code[at : at + WINDOW]
    return np.pad(part, (0, WINDOW - len(part)), constant_values=SYMBOLS)


def _runs(tags: Iterable[int], at: int) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the begin-inside runs of one window."""
    out, open_ = [], None
    for k, t in enumerate([*tags, 0]):
        if open_ and t != open_[0] * 2 + 2:
            out.append((open_[0], open_[1] + at, k + at))
            open_ = None
        if t % 2 == 1:
            open_ = ((t - 1) // 2, k)
    return out


def plausible(kind: str, text: str) -> bool:
    """What a span of the tagger must hold besides its shape: a sure sign of its kind, never a plain number or word."""
    digits = _only_digits(text)
    if kind == "email":
        sign = "@" in text or SPELLED.search(text) is not None
        both = re.search(r"@|\bat\b", text, re.IGNORECASE) and re.search(r"\.|\bdot\b", text, re.IGNORECASE)
        return sign and both is not None and sum(c.isalnum() for c in text) >= 6
    if kind == "ip":
        parts = DIGITS.findall(text)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts) and text != digits
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    # a bare run of digits may be anything: a phone number without plus sign has its separators
    return 9 <= len(digits) <= 15 and len(re.findall(r"[^0-9]+", text.strip("+ "))) >= 2 and PHONE_LIKE.fullmatch(text) is not None


def reconcile(text: str, decoded: list[tuple[int, np.ndarray, np.ndarray]], base: list[tuple[str, int, int]], least: float) -> list[tuple[str, int, int]]:
    """One set of added spans from all windows of a text (start, tags, confidences).

    Of overlapping candidates the one farther from its window's edges and then of more confidence wins, so that a span
    cut by a window's edge gives way to the whole one; then those that overlap a span of the rules, that the tagger is
    not sure of, or that are not plausible go."""
    found = {}
    for at, tags, share in decoded:
        end = min(at + WINDOW, len(text))
        for kind, a, b in _runs(tags.tolist(), at):
            inside = min(a - at if at else WINDOW, end - b if end < len(text) else WINDOW)
            sure = float(share[a - at : b - at].mean())
            key = (kind, a, b)
            found[key] = max(found.get(key, (0, 0.0)), (min(inside, 8), sure))
    kept: list[tuple[str, int, int]] = []
    taken: list[tuple[int, int]] = []  # apart from each other, in order
    for _, a, b in sorted(base, key=lambda s: s[1]):
        if taken and a < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(b, taken[-1][1]))
        else:
            taken.append((a, b))
    for (kind, a, b), (_, sure) in sorted(found.items(), key=lambda s: (-s[1][0], -s[1][1], s[0][1])):
        before = bisect_left(taken, (b,))
        if before and taken[before - 1][1] > a:
            continue
        if sure >= least and plausible(KINDS[kind], text[a:b]):
            kept.append((KINDS[kind], a, b))
            insort(taken, (a, b))
    return kept


# --- training data ----------------------------------------------------------------------------------------------------


def rewritten(kind: str, text: str, r: random.Random) -> str:
    """The same personal data in another form that people write, which the rules miss."""
    if kind == "email":
        local, _, host = text.partition("@")
        at = r.choice([" at ", " (at) ", " [at] ", "(at)", "[at]", " AT ", " @ "])
        dot = r.choice([" dot ", " (dot) ", " [dot] ", "(dot)", "[dot]", ".", " DOT "])
        if at == " @ ":
            dot = r.choice([" . ", "."])
        if "dot" in dot.lower() and r.random() < 0.5:
            local = local.replace(".", dot)
        return local + at + host.replace(".", dot)
    if kind == "ip":
        return text.replace(".", r.choice(["[.]", " . ", "(.)", " dot ", "-dot-"]))
    digits = _only_digits(text)
    if kind == "card":
        gap = r.choice([".", "  ", " - ", "/", "_"])
        return gap.join(digits[k : k + 4] for k in range(0, len(digits), 4))
    area, first, last = digits[-10:-7], digits[-7:-4], digits[-4:]
    lead = r.choice(["", "", "00" + digits[:-10] + " ", digits[:-10] + " "])
    return lead + r.choice([f"({area}) {first}-{last}", f"{area}-{first}-{last}", f"{area}.{first}.{last}", f"{area} {first} {last}", f"({area}){first}-{last}", f"{area}/{first}-{last}"])


def _decoys(r: random.Random) -> str:
    """Numbers and words that look like personal data and are none: the tagger must leave them alone."""
    n = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    return r.choice([
        n(r.randint(1, 22)), f"{n(1)}.{n(2)}.{n(1)}", f"20{n(2)}-{n(2)}-{n(2)}", f"{n(2)}:{n(2)}:{n(2)}", f"{n(3)},{n(3)},{n(3)}", f"v{n(1)}.{n(1)}", f"${n(3)}.{n(2)}",
        f"{n(4)}-{n(4)}", "look at the dot on it", "at home", f"at {n(2)} dot", f"@{r.choice(['user', 'name', 'here'])}", f"{n(2)} % at {n(1)}.{n(2)}", hashlib.md5(n(8).encode()).hexdigest(),
        f"{n(2)}/{n(2)}/20{n(2)}", f"{n(3)}.{n(3)}.{n(3)}.{n(3)}{n(2)}", f"ISBN {n(3)}-{n(1)}-{n(5)}-{n(3)}-{n(1)}", f"{n(2)}.{n(2)}.{n(4)}", f"+{n(2)} %", f"({n(4)})", f"{n(5)} {n(3)}",
    ])


def examples(pieces: list[str], seed: int = 0, variants: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, tags) of windows: pieces of texts with the rules' spans as they stand, rewritten, and with decoys."""
    r = random.Random(seed)
    xs, ys = [], []

    def add(parts: list[tuple[str, str | None]]) -> None:
        text = "".join(t for t, _ in parts)
        tags = np.zeros(len(text), np.int8)
        at = 0
        for t, kind in parts:
            if kind and t:
                k = 1 + 2 * KINDS.index(kind)
                tags[at : at + len(t)] = k + 1
                tags[at] = k
            at += len(t)
        code = symbols(text)
        shift = r.randint(0, max(0, len(code) - WINDOW))
        # a window starts on a tag a CRF may start with: a span cut at its start is not shown
        while shift < len(tags) and tags[shift] and tags[shift] % 2 == 0:
            shift += 1
        y = tags[shift : shift + WINDOW]
        xs.append(_filled(code, shift))
        ys.append(np.pad(y, (0, WINDOW - len(y))))

    for piece in pieces:
        spans, clear, at = rule_spans(piece), [], 0
        parts: list[tuple[str, str | None]] = []
        for kind, a, b in spans:
            if a >= at:
                parts += [(piece[at:a], None), (piece[a:b], kind)]
                clear.append((kind, piece[a:b]))
                at = b
        parts.append((piece[at:], None))
        add(parts)
        for _ in range(variants if clear else 1):
            if clear and r.random() < 0.75:
                add([(rewritten(k, t, r) if k and r.random() < 0.8 else t, k) for t, k in parts])
            else:
                add([(_decoys(r) if k else t, None) for t, k in parts] if clear else [(piece[: WINDOW // 3], None), (f" {_decoys(r)} ", None), (piece[WINDOW // 3 :], None)])
    return np.array(xs, np.int64).reshape(-1, WINDOW), np.array(ys, np.int8).reshape(-1, WINDOW)


def _cut(texts: list, per_text: int) -> list[str]:
    """Pieces around spans of the rules, and one that starts at a place the text's length gives."""
    out = []
    for text in texts:
        if not text:
            continue
        for _, a, b in rule_spans(text)[:per_text]:
            if b - a <= WINDOW:
                out.append(text[max(0, a - WINDOW // 2) : b + WINDOW // 2])
        at = len(text) * 5 // 8
        out.append(text[at : at + WINDOW])
    return out


#: Plain words around made-up spans, so that the tagger knows every kind in any wording and even without a sample.
WORDS = "please write to call me at or on the number before noon card was used host is down again from and back paid by with contact us for more about it our office phone mail server address reach now see a of in".split()


def made_up(seed: int, how_many: int) -> list[str]:
    """Sentences of plain words with one or two spans of random letters and digits."""
    r = random.Random(seed)
    digit = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    name = lambda a, b: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(a, b)))

    def card() -> str:
        body = r.choice("3456") + digit(14)
        whole = next(body + c for c in "0123456789" if luhn(body + c))
        return r.choice(["", " ", "-"]).join(whole[k : k + 4] for k in range(0, 16, 4))

    kinds = (
        lambda: r.choice([name(2, 8), f"{name(2, 7)}.{name(2, 9)}", f"{name(3, 6)}_{digit(2)}", f"{name(1, 1)}.{name(3, 8)}{digit(1)}"]) + "@" + r.choice(["", f"{name(2, 5)}{digit(1)}."]) + name(2, 9) + "." + r.choice(["com", "org", "net", "co.uk", "de", "fr", "es", "eu"]),
        lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)),
        card,
        lambda: "+" + r.choice([f"1 ({digit(3)}) {digit(3)}-{digit(4)}", f"{r.randint(20, 99)} {digit(2)} {digit(4)} {digit(4)}", f"1-{digit(3)}-{digit(3)}-{digit(4)}", f"{r.randint(20, 99)} {digit(3)} {digit(7)}"]),
    )
    out = []
    for _ in range(how_many):
        words = [r.choice(WORDS) if r.random() < 0.7 else name(2, 9) for _ in range(r.randint(4, 12))]
        for _ in range(r.randint(1, 2)):
            words.insert(r.randint(0, len(words)), r.choice(kinds)() + r.choice(["", "", ",", ".", ";"]))
        out.append(" ".join(words))
    return out


def fit(docs: DataFrame, text_col: str = "text", sample: int = 300, passes: int = 6, seed: int = 0) -> Tagger:
    """A tagger trained on the rules' spans of at most `sample` texts that have some and `sample` that have none.

    The sample is the first of each kind by a hash of what is taken from them, so copies count once and it is the same
    in every run; of each text at most two spans with their surroundings come to the driver, never the text. Null and empty texts teach nothing, whole texts of any length are read, other columns are ignored, and an
    empty table leaves the tagger with its made-up sentences."""
    rows = docs.select(F.col(text_col).alias("t"))

    def start():
        return lambda texts: [[bool(t) and bool(rule_spans(t)) for t in texts], [_cut([t], 2) for t in texts]]

    cut = with_text_columns(rows, [], "t", "hit boolean, pieces array<string>", start).where(F.size("pieces") > 0)
    hashed = cut.select("hit", F.xxhash64("pieces").alias("h"), "pieces")
    # the first of each hash bucket, so at most 8 * sample rows come here, whatever the corpus
    firsts = hashed.groupBy("hit", F.pmod("h", F.lit(4 * sample)).alias("k")).agg(F.min(F.struct("h", "pieces")).alias("m"))
    found = sorted((r["m"]["h"], r["hit"], r["m"]["pieces"]) for r in firsts.collect())
    picked = [[p for _, hit, p in found if hit == kind][:sample] for kind in (True, False)]
    x, y = examples([*made_up(seed, 6 * sample), *(p for pieces in picked for texts in pieces for p in texts)], seed)
    spark = docs.sparkSession
    given = spark.sparkContext.broadcast((x, y))  # some thousands of windows: bounded by the sample

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [pickle.dumps(Tagger.fresh(seed=seed).train(*given.value, passes).p) for _ in range(len(batch))]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["p"])

    # one task on an executor, with as many threads as a task has
    return Tagger(pickle.loads(spark.range(1, numPartitions=1).mapInArrow(train, "p binary").first()["p"]))


def find(docs: DataFrame, tagger: Tagger, keep: list[str], text_col: str = "text", least: float = 0.6) -> DataFrame:
    """The columns `keep` with base (the rules' spans), base_sha256 and added (the tagger's), arrays of (kind, start, end).

    Positions count code points, ends are exclusive. Added spans overlap none of the rules' and hold a sign of their
    kind; windows without a digit, an at sign or the words at and dot are not run, since no such span lies in them.
    Null and empty texts have no spans; repeated rows are repeated; other columns are ignored, whatever their names; an
    empty table gives no rows. Whole texts are read; long ones are run a bounded number of windows at a time."""
    shared = docs.sparkSession.sparkContext.broadcast(tagger)  # some thousands of numbers

    def start():
        model, many = shared.value, 256

        def work(texts: list) -> list[list]:
            base = [rule_spans(t or "") for t in texts]
            decoded: list[list] = [[] for _ in texts]
            queue: list[tuple[int, int, np.ndarray]] = []

            def run() -> None:
                tags, share = model.tags(np.array([x for _, _, x in queue]).T)
                for k, (owner, at, _) in enumerate(queue):
                    if tags[:, k].any():
                        decoded[owner].append((at, tags[:, k], share[:, k]))
                queue.clear()

            for k, text in enumerate(texts):
                starts = windows(text or "")
                for at in starts:
                    queue.append((k, at, _filled(symbols(text[at : at + WINDOW]), 0)))
                    if len(queue) == many:
                        run()
            if queue:
                run()
            added = [reconcile(t or "", d, b, least) for t, d, b in zip(texts, decoded, base, strict=True)]
            as_rows = lambda spans: [{"kind": k, "start": a, "end": b} for k, a, b in spans]
            return [[as_rows(b) for b in base], [hashlib.sha256(listed(b).encode()).hexdigest() for b in base], [as_rows(a) for a in added],
                    [listed(sorted([*b, *a], key=lambda s: (s[1], KINDS.index(s[0])))) for b, a in zip(base, added, strict=True)]]

        return work

    return with_text_columns(docs, keep, text_col, f"base array<{SPAN}>, base_sha256 string, added array<{SPAN}>, spans string", start)


def listed(spans: list[tuple[str, int, int]]) -> str:
    """Spans as kind:start:end joined by commas."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def count_kind(kind: str) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
