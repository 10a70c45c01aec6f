"""Operator 1, secret scans with a linear-chain conditional random field.

Three base patterns always count. Beside them a CRF tags every token as begin, inside or outside of a
secret from its shape, its neighbouring words and features of the whole text, decoded by Viterbi.
The CRF is trained here on generated lines (no labels of secrets exist): credentials of many formats
in many phrasings against look-alikes such as hashes of commits, ids, addresses and numbers.
"""

from __future__ import annotations

import math
import random
import re
import string
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # runs are maximal, so a shorter run is one that fails
KINDS = ("assign", "access", "hex", "crf")
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
O, B, I = 0, 1, 2
LEAST = 4  # characters of a span that the CRF adds; shorter strings stand in every text, and as secrets (a PIN has four) are not in use

#: Words that tell about the token after or before them.
HINTS = (
    "key", "apikey", "token", "secret", "password", "passwd", "passphrase", "pwd", "pass", "bearer", "authorization", "auth", "credential", "credentials",
    "login", "access", "private", "signature", "session", "cookie", "client", "webhook", "license", "pin", "otp", "api", "export", "set",
    "commit", "hash", "sha", "sha1", "sha256", "md5", "checksum", "uuid", "id", "order", "invoice", "version", "build", "revision", "mail", "email", "url", "phone", "call", "see", "ref", "isbn",
)
_HINT = frozenset(HINTS)
#: Words of letters with marks after them; what a token's features ask beyond _shared_key can't hold for them.
_SIMPLE = re.compile(r"(?![a-fA-F]{16})([^\W\d_]{1,20})[.,;!?]{0,2}(?:###|\$\$\$|%%%|&&&|\*\*\*)?\Z")
_RUNS = re.compile(r"(.)\1\1")
_PARTS = re.compile(r"[a-z0-9]+")
_PREFIX = re.compile(r"(gh[pousr]_|github_pat_|sk[-_]|pk[-_]|rk[-_]|xox[abprs]-|eyJ|AIza|AKIA|ASIA|ya29\.|glpat-|npm_|SG\.|hf_|-----BEGIN|-----END)")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the base matches, in code points; per kind leftmost and non-overlapping."""
    out = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "key" in low:
        out += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    out.sort(key=lambda s: (s[0], s[2]))
    return out


def join_spans(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


def _value(token: str) -> str:
    """The part of a token that can be a secret: after `name=` or `name:`, without quotes and marks around it."""
    m = re.match(r"""["'`(\[{<]*[A-Za-z_][\w.-]*["']?[=:]["'`]?(?=.{6})(?!//)""", token)
    v = token[m.end() :] if m else token
    return v.strip("\"'`,;()[]{}<>.!?")


_NLOGN = [0.0, *(k * math.log2(k) for k in range(1, 201))]


def _entropy(v: str) -> float:
    n = len(v)
    if n > 200:
        return math.log2(n) - sum(c * math.log2(c) for c in Counter(v).values()) / n
    return math.log2(n) - sum([_NLOGN[v.count(x)] for x in set(v)]) / n if n else 0.0


def token_features(token: str) -> list[str]:
    """Shape of one token."""
    v = _value(token)
    n = len(v)
    low, up, dig = sum(map(str.islower, v)), sum(map(str.isupper, v)), sum(map(str.isdigit, v))
    sym = n - low - up - dig
    kinds = (low > 0) + (up > 0) + (dig > 0)
    turns = sum(1 for a, b in zip(v, v[1:]) if a.isdigit() != b.isdigit())
    f = [
        "bias",
        f"len{min(9, n // 5)}",
        f"ent{int(min(5.9, _entropy(v)) * 2)}",
        f"kinds{kinds}{'s' if sym else ''}",
        f"dig{int(4 * dig / n) if n else 0}",
        f"turns{min(6, turns)}",
        "named" if v != token and re.match(r"""["']?[A-Za-z_][\w.-]*["']?[=:]""", token) else "bare",
    ]
    if n >= 12 and kinds == 3:
        f.append("mixed")
        if sym / n < 0.15:
            f.append("mixedlong" if n >= 20 else "mixedmid")
    if re.fullmatch(r"[0-9a-fA-F]{16,}", v):
        f.append("hexrun")
    if re.fullmatch(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", v):
        f.append("uuid")
    if _PREFIX.match(v):
        f.append("prefix" + ("long" if n >= 16 else ""))
    if v.startswith("-----"):
        f.append("pem")
    if re.fullmatch(r"[A-Za-z0-9+/]{40,}={0,2}", v):
        f.append("b64line")
    if re.search(r"://[^/\s:@]+:[^/\s:@]+@", v):
        f.append("urlcred")
    elif "://" in v or v.startswith("www."):
        f.append("url")
    elif "@" in v:
        f.append("at")
    elif "/" in v and sym > 2:
        f.append("path")
    if dig == 0 and kinds <= 2:
        f.append("letters")
    if low == 0 and up == 0:
        f.append("numbers")
    if any(ord(c) > 127 for c in v):
        f.append("nonascii")
    if _RUNS.search(v):
        f.append("runs")
    name = re.match(r"""["'`]*([A-Za-z_][\w.-]*)["']?[=:]""", token)
    if name:
        f += [f"name_{h}" for h in _hints(name[1])]
    f += [f"is_{h}" for h in _hints(token) if n < 20]
    return f


def _hints(token: str) -> list[str]:
    low = token.lower()
    found = _HINT.intersection(_PARTS.findall(low))
    return sorted(found | {"key"} if "apikey" in low else found)


def side_features(token: str) -> list[str]:
    """What a neighbour sees of a token."""
    v = token.strip("\"'`,;()[]{}<>.!?")
    f = [f"w_{h}" for h in _hints(token) if len(v) < 30] or ["w_other"]
    if token[-1:] in "=:":
        f.append("mark")
    if len(v) >= 12 and any(map(str.isdigit, v)) and any(map(str.isalpha, v)):
        f.append("odd")
    if re.fullmatch(r"[A-Za-z0-9+/]{40,}={0,2}", v):
        f.append("b64line")
    if v.startswith("-----"):
        f.append("pem")
    if re.fullmatch(r"[^\W\d_]+", v):
        f.append("word")
    return f


def file_features(text: str, n_words: int) -> list[str]:
    """Features of the whole text: how much it looks like configuration or code, and key blocks."""
    marks = text.count("=") + text.count(": ")
    f = [f"f_cfg{min(3, int(10 * marks / (n_words + 1)))}"]
    if "PRIVATE KEY" in text:
        f.append("f_pem")
    if "#!/" in text or "export " in text or "<?" in text:
        f.append("f_code")
    return f


# ---------------------------------------------------------------- generated training lines
_ALNUM = string.ascii_letters + string.digits


def _rand(r: random.Random, n: int, chars: str = _ALNUM) -> str:
    return "".join(r.choice(chars) for _ in range(n))


def _plain(r: random.Random) -> str:
    syllables = "the an re in on er ti al or is en es ou la con der sch ion ar ment que ad ver pre ly ing to of".split()
    w = "".join(r.choice(syllables) for _ in range(r.randint(1, 5)))
    w = w.capitalize() if r.random() < 0.2 else w.upper() if r.random() < 0.03 else w
    return w + (r.choice(".,;:!?") if r.random() < 0.15 else r.choice(["###", "$$$", "%%%", "&&&", "***"]) if r.random() < 0.06 else "")


def _secret(r: random.Random) -> list[str]:
    k = r.randrange(13)
    if k == 0:
        return ["ghp_" + _rand(r, 36)]
    if k == 1:
        return [r.choice(["sk_live_", "sk-", "pk_live_", "rk_live_"]) + _rand(r, r.randint(20, 48))]
    if k == 2:
        return [r.choice(["xoxb-", "xoxp-"]) + _rand(r, 11, string.digits) + "-" + _rand(r, 24)]
    if k == 3:
        return ["eyJ" + _rand(r, 30) + "." + "eyJ" + _rand(r, 40) + "." + _rand(r, 43, _ALNUM + "-_")]
    if k == 4:
        return ["AIza" + _rand(r, 35, _ALNUM + "-_")]
    if k == 5:
        return [r.choice(["postgres", "mysql", "amqp", "redis", "https"]) + "://" + _rand(r, 6, string.ascii_lowercase) + ":" + _rand(r, r.randint(8, 20)) + "@" + _rand(r, 6, string.ascii_lowercase) + ".example.com/" + _rand(r, 4, string.ascii_lowercase)]
    if k == 6:
        return [_rand(r, 40, _ALNUM + "+/")]
    if k == 7:
        return ["-----BEGIN", r.choice(["RSA", "EC", "OPENSSH"]), "PRIVATE", "KEY-----", *[_rand(r, 64, _ALNUM + "+/") for _ in range(r.randint(2, 5))], "-----END", "PRIVATE", "KEY-----"]
    if k == 8:
        return [_rand(r, r.randint(8, 16), _ALNUM + "!@#$%^&*")]
    if k == 9:
        return [_rand(r, r.randint(20, 44), _ALNUM + "-_")]
    if k == 10:
        return [_rand(r, r.choice([16, 20, 24, 32, 40]), "0123456789abcdef")]
    if k == 11:
        return ["glpat-" + _rand(r, 20, _ALNUM + "-_")]
    return [_rand(r, r.randint(3, 6)) + _rand(r, 2, string.digits) for _ in range(r.randint(3, 5))]


def _lookalike(r: random.Random) -> list[str]:
    k = r.randrange(16)
    d = string.digits
    return [
        lambda: [r.choice(["commit", "sha1", "revision", "hash:", "checksum"]), _rand(r, 40, "0123456789abcdef")],
        lambda: [r.choice(["uuid", "id:", "order", "ref"]), "-".join(_rand(r, n, "0123456789abcdef") for n in (8, 4, 4, 4, 12))],
        lambda: [_rand(r, 5, string.ascii_lowercase) + "." + _rand(r, 2, d) + "@" + "mail" + _rand(r, 1, d) + ".example.com"],
        lambda: ["https://" + _rand(r, 7, string.ascii_lowercase) + ".example.org/" + _rand(r, 6, string.ascii_lowercase) + "?page=" + _rand(r, 2, d) + "&ref=" + _rand(r, 5)],
        lambda: [".".join(str(r.randint(0, 255)) for _ in range(4))],
        lambda: [_rand(r, 16, d)],
        lambda: ["+" + _rand(r, 2, d), _rand(r, 3, d), _rand(r, 7, d)],
        lambda: [r.choice(["version", "build"]), "v" + _rand(r, 1, d) + "." + _rand(r, 2, d) + "." + _rand(r, 3, d)],
        lambda: [_rand(r, 8, string.ascii_lowercase).capitalize() + _rand(r, 7, string.ascii_lowercase).capitalize() + "Factory"],
        lambda: ["/usr/" + _rand(r, 5, string.ascii_lowercase) + "/" + _rand(r, 8, string.ascii_lowercase) + _rand(r, 2, d) + ".so"],
        lambda: [r.choice(["the", "this", "my", "reset"]), r.choice(["password", "token", "key", "secret"]), r.choice(["is", "was", "must", "expired"]), _plain(r), _plain(r)],
        lambda: [r.choice(["isbn", "invoice", "order"]), _rand(r, 3, d) + "-" + _rand(r, 10, d)],
        lambda: [_rand(r, 4, d) + "-" + _rand(r, 2, d) + "-" + _rand(r, 2, d) + "T" + _rand(r, 2, d) + ":" + _rand(r, 2, d) + ":00Z"],
        lambda: [_plain(r).upper() + "!!" for _ in range(4)],
        lambda: [_plain(r).capitalize()] * r.randint(4, 14),
        lambda: [_plain(r).capitalize(), _plain(r)] * r.randint(3, 8),
    ][k]()


def _line(r: random.Random) -> tuple[list[str], list[int]]:
    toks: list[str] = []
    tags: list[int] = []

    def add(ts, secret=False):
        for i, t in enumerate(ts):
            toks.append(t)
            tags.append((B if i == 0 else I) if secret else O)

    add(_plain(r) for _ in range(r.randint(2, 9)))
    for _ in range(r.randint(1, 2)):
        if r.random() < 0.55:
            s = _secret(r)
            strong = bool(_PREFIX.match(s[0])) or "://" in s[0]
            style = r.randrange(6) if not (strong and r.random() < 0.5) else 6
            name = r.choice(["password", "secret", "api key", "token", "access key", "client secret", "private key", "passphrase", "auth token", "credentials", "session key", "webhook secret", "pwd", "pass"]).split()
            if style == 0:
                add([*name[:-1], name[-1] + ":"])
            elif style == 1:
                add([*name, "="])
            elif style == 2:
                add([*name, "is"])
            elif style == 3 and len(s) == 1:
                s = ["_".join(name).upper() + r.choice(["=", ":"]) + r.choice(["", '"', "'"]) + s[0]]
            elif style == 4:
                add(["Authorization:", "Bearer"])
            elif style == 5:
                add(["export", *name])
            add(s, True)
        else:
            add(_lookalike(r))
        add(_plain(r) for _ in range(r.randint(1, 7)))
    return toks, tags


def _setting(r: random.Random) -> tuple[list[str], list[int]]:
    """A line of configuration without a secret."""
    name = "_".join(_plain(r).rstrip(".,;:!?#$%&*") for _ in range(r.randint(1, 2)))
    value = r.choice([_rand(r, r.randint(1, 4), string.digits), "true", "false", _rand(r, r.randint(3, 9), string.ascii_lowercase), "/etc/" + _rand(r, 6, string.ascii_lowercase)])
    toks = [f"{name}={value}"] if r.random() < 0.4 else [name + ":", value] if r.random() < 0.5 else [name, "=", value]
    return toks, [O] * len(toks)


def _document(r: random.Random) -> tuple[list[tuple[list[str], list[int]]], str]:
    """Lines of a whole text, and that text: prose of up to 40 lines, or configuration and code among them."""
    lines = [_line(r)]
    kind = r.random()
    for _ in range(r.choice([0, 0, 1, 2, 4, 8])):
        lines.append(_setting(r) if kind < 0.3 else _line(r))
    filler = [] if r.random() < 0.4 else [" ".join(_plain(r) for _ in range(r.randint(10, 60))) for _ in range(r.randint(1, 30))]
    head = r.choice(["#!/bin/sh", "<?php", "export PATH"]) + "\n" if kind < 0.12 else ""
    return lines, head + "\n".join([*(" ".join(t) for t, _ in lines), *filler])


# ---------------------------------------------------------------- the model
class Crf:
    """Weights of a linear chain over O, B, I. Emissions are sums over a token, its two neighbours and the file, so each is looked up once per distinct token."""

    def __init__(self, weights: dict[str, np.ndarray], trans: np.ndarray):
        self.weights, self.trans = weights, trans
        # how much better than O a label x may make the transitions around a token: before it, after it
        # towards O or B, and after it towards I (then against O followed by B)
        t = trans
        self.lead = {x: (float((t[:, x] - t[:, O]).max()), float((t[x, :I] - t[O, :I]).max()), float(t[x, I] - t[O, B] + (t[I] - t[B]).max())) for x in (B, I)}
        self.reset()

    def reset(self) -> None:
        self.rows = np.zeros((1024, 9))
        self.rows[0, 3:] = 0
        self.n = 1  # row 0: beyond the text's ends
        self.table = _Table(self)
        self.simple: dict[tuple, int] = {}

    def sums(self, prefix: str, features: list[str]) -> np.ndarray:
        out = np.zeros(3)
        for f in features:
            w = self.weights.get(prefix + f)
            if w is not None:
                out += w
        return out

    def add(self, token: str) -> int:
        if self.n == len(self.rows):
            self.rows = np.concatenate((self.rows, np.zeros_like(self.rows)))
        side = side_features(token)
        self.rows[self.n] = np.concatenate((self.sums("c:", token_features(token)), self.sums("p:", side), self.sums("n:", side)))
        self.n += 1
        return self.n - 1

    def tags(self, tokens: list[str], text: str) -> tuple[np.ndarray, list[int]] | None:
        """Positions and labels of the tokens outside label O, or None.

        A token is O on the best path for sure if any path with another label there gets better by
        putting O (and B for an I that follows); only the runs between such tokens go through
        Viterbi, which keeps it exact.
        """
        n = len(tokens)
        if not n:
            return None
        if len(self.table) > 400_000 or self.n > 200_000 or self.table.chars > 20_000_000:
            self.reset()
        at = np.fromiter(map(self.table.__getitem__, tokens), np.int64, n)
        rows = self.rows
        e = rows[at, 0:3] + self.sums("", file_features(text, n))
        e[1:] += rows[at[:-1], 3:6]
        e[:-1] += rows[at[1:], 6:9]
        start = np.append(e[1:, B] - e[1:, I], np.inf)
        sure = np.ones(n, bool)
        for x, (before, after, inside) in self.lead.items():
            ahead = e[:, O] - e[:, x] - before
            sure &= (ahead > after) & (ahead + start > inside)
        open_ = np.flatnonzero(~sure)
        if not len(open_):
            return None
        found, labels = [], []
        for run in np.split(open_, np.flatnonzero(np.diff(open_) > 1) + 1):
            for p, y in zip(run.tolist(), viterbi(e[run], self.trans), strict=True):
                if y != O:
                    found.append(p)
                    labels.append(y)
        return (np.array(found), labels) if found else None


def _shared_key(token: str) -> tuple | None:
    """All facts that the features of a plain word depend on, so that words of one key share a row; None for other tokens."""
    m = _SIMPLE.match(token)
    if not m or _hints(token) or _PREFIX.match(token):
        return None
    v = token.strip("\"'`,;()[]{}<>.!?")
    low, up = sum(map(str.islower, v)), sum(map(str.isupper, v))
    if low + up != len(m[1]):  # letters without case, or digits that are no decimal ones
        return None
    return low > 0, up > 0, token[m.end(1) :], len(v) // 5, int(min(5.9, _entropy(v)) * 2), v.isascii(), bool(_RUNS.search(v))


class _Table(dict):
    def __init__(self, crf: Crf):
        super().__init__()
        self.crf = crf
        self.chars = 0

    def __missing__(self, token: str) -> int:
        crf = self.crf
        key = _shared_key(token)
        i = None if key is None else crf.simple.get(key)
        if i is None:
            i = crf.add(token)
            if key is not None:
                crf.simple[key] = i
        self[token] = i
        self.chars += len(token)
        return i


def viterbi(e: np.ndarray, trans: np.ndarray) -> list[int]:
    """Best labels of a run with O on both sides."""
    t = trans.tolist()
    rows = e.tolist()
    best = [rows[0][y] + t[O][y] for y in range(3)]
    back = []
    for r in rows[1:]:
        step = [max(range(3), key=lambda x, y=y: best[x] + t[x][y]) for y in range(3)]
        back.append(step)
        best = [best[step[y]] + t[step[y]][y] + r[y] for y in range(3)]
    y = max(range(3), key=lambda x: best[x] + t[x][O])
    out = [y]
    for step in reversed(back):
        y = step[y]
        out.append(y)
    return out[::-1]


@lru_cache(maxsize=2)
def train(lines: int = 2500, epochs: int = 6, seed: int = 11) -> Crf:
    """Maximum conditional likelihood by AdaGrad; forward and backward sums per generated line, with the file features of the text around it."""
    r = random.Random(seed)
    data = []
    index: dict[str, int] = {}
    code = lambda fs: [index.setdefault(f, len(index)) for f in fs]
    made: list[tuple[list[str], list[int], list[str]]] = []
    while len(made) < lines:
        some, text = _document(r)
        ff = file_features(text, len(TOKEN.findall(text)))
        made += [(toks, tags, ff) for toks, tags in some]
    for toks, tags, ff in made:
        side = [side_features(t) for t in toks]
        feats = []
        for i, t in enumerate(toks):
            f = ["c:" + x for x in token_features(t)] + ff
            if i:
                f += ["p:" + x for x in side[i - 1]]
            if i + 1 < len(toks):
                f += ["n:" + x for x in side[i + 1]]
            feats.append(code(f))
        data.append((feats, tags))
    w = np.zeros((len(index), 3))
    gw = np.full_like(w, 1e-3)
    trans = np.zeros((3, 3))
    trans[O, I] = -3.0
    gt = np.full_like(trans, 1e-3)
    for _ in range(epochs):
        r.shuffle(data)
        for feats, tags in data:
            n = len(feats)
            flat = np.concatenate([np.array(f) for f in feats])
            own = np.repeat(np.arange(n), [len(f) for f in feats])
            e = np.zeros((n, 3))
            np.add.at(e, own, w[flat])
            a, b = np.zeros((n, 3)), np.zeros((n, 3))
            a[0] = e[0] + trans[O]
            for i in range(1, n):
                x = a[i - 1][:, None] + trans
                m = x.max(0)
                a[i] = e[i] + m + np.log(np.exp(x - m).sum(0))
            b[-1] = trans[:, O]
            for i in range(n - 2, -1, -1):
                x = trans + (e[i + 1] + b[i + 1])[None, :]
                m = x.max(1)
                b[i] = m + np.log(np.exp(x - m[:, None]).sum(1))
            x = a[-1] + b[-1]
            z = x.max() + np.log(np.exp(x - x.max()).sum())
            g = np.exp(a + b - z)
            y = np.array(tags)
            g[np.arange(n), y] -= 1
            dt = np.zeros((3, 3))
            if n > 1:
                dt += np.exp(a[:-1, :, None] + trans[None] + (e + b)[1:, None, :] - z).sum(0)
                np.add.at(dt, (y[:-1], y[1:]), -1)
            grad = np.zeros((n, 3)) + g
            ids, inv = np.unique(flat, return_inverse=True)
            d = np.zeros((len(ids), 3))
            np.add.at(d, inv, grad[own])
            d += 1e-4 * w[ids]
            gw[ids] += d * d
            w[ids] -= 0.3 * d / np.sqrt(gw[ids])
            gt += dt * dt
            trans -= 0.1 * dt / np.sqrt(gt)
    return Crf({f: w[i] for f, i in index.items()}, trans)


def crf_spans(text: str, crf: Crf, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of the CRF's secrets that touch no base span; quotes, marks and names around a value are left out."""
    got = crf.tags(TOKEN.findall(text), text)
    if got is None:
        return []
    at = [m.span() for m in TOKEN.finditer(text)]
    runs: list[list[int]] = []
    for p, y in zip(got[0].tolist(), got[1], strict=True):
        if y == B or not runs or runs[-1][-1] != p - 1:
            runs.append([p])
        else:
            runs[-1].append(p)
    out = []
    for run in runs:
        first, last = text[slice(*at[run[0]])], text[slice(*at[run[-1]])]
        v = _value(first) if not first.startswith("-----") else first
        s = at[run[0]][0] + (first.rindex(v) if v else 0)
        e = at[run[-1]][0] + len(last.rstrip("\"'`,;()[]{}<>.!?"))
        if e - s >= LEAST:
            out.append((s, e, 3))
    return apart(out, base)


def apart(spans: list[tuple[int, int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The spans, in order of their starts, that touch none of base: one sweep over both."""
    taken, reach, at, out = sorted(base), -1, 0, []
    for s, e, k in spans:
        while at < len(taken) and taken[at][0] < e:
            reach = max(reach, taken[at][1])
            at += 1
        if reach <= s:
            out.append((s, e, k))
    return out


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, spans (array of kind, start, end; code points, end exclusive) of every row; base spans first in ties.

    Null and empty texts have no spans. Rows are independent: repeated rows repeat, their order and
    partitions do not matter, ids may be null, other columns are ignored; an empty table gives no rows.
    """
    model = train()
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.trans))
    kind = docs.select(key).schema[0].dataType.simpleString()
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        crf = Crf(*shared.value)
        for b in batches:
            out = []
            for t in b.column(1):
                t = t.as_py() or ""
                base = base_spans(t)
                every = sorted(base + crf_spans(t, crf, base), key=lambda s: (s[0], s[2]))
                out.append([{"kind": KINDS[k], "start": s, "end": e} for s, e, k in every])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, span)], [key, "spans"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(table(spark, sf_dir, "documents"))
    said = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.array_join(F.transform(F.filter("spans", lambda s: s["kind"] != "crf"), said), ",")
    return out.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(base.cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", said), ",").alias("spans"),
        count("crf").alias("n_crf"),
    )
