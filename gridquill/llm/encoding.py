"""Text decoded with the wrong character encoding: detection and restoration."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from html.entities import html5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread

#: Rows of the corpus that the classifier is fitted on, at most.
TRAIN_ROWS = 4_000
#: Buckets of the hashed byte bigrams.
BUCKETS = 1 << 14
#: Prior probability of clean text, and the log-odds a garbled reading must win by.
CLEAN_PRIOR = 0.9
MARGIN = 4.0

#: Chains: steps of (encoding the bytes were written in, encoding they were read in).
CHAINS: dict[str, tuple[tuple[str, str], ...]] = {
    "utf8>cp1252": (("utf-8", "cp1252"),),
    "utf8>latin1": (("utf-8", "latin-1"),),
    "utf8>cp1252 twice": (("utf-8", "cp1252"), ("utf-8", "cp1252")),
    "utf8>latin1 twice": (("utf-8", "latin-1"), ("utf-8", "latin-1")),
    "utf8>cp437": (("utf-8", "cp437"),),
    "utf8>cp850": (("utf-8", "cp850"),),
    "utf8>mac_roman": (("utf-8", "mac_roman"),),
    "utf8>cp1251": (("utf-8", "cp1251"),),
    "utf8>cp1250": (("utf-8", "cp1250"),),
    "utf8>koi8_r": (("utf-8", "koi8_r"),),
    "utf8>cp866": (("utf-8", "cp866"),),
    "cp1251>cp1252": (("cp1251", "cp1252"),),
    "koi8_r>cp1252": (("koi8_r", "cp1252"),),
    "cp1251>koi8_r": (("cp1251", "koi8_r"),),
    "koi8_r>cp1251": (("koi8_r", "cp1251"),),
    "cp866>cp1251": (("cp866", "cp1251"),),
    "cp1251>cp866": (("cp1251", "cp866"),),
    "cp1250>cp1252": (("cp1250", "cp1252"),),
    "iso8859_2>cp1252": (("iso8859_2", "cp1252"),),
    "iso8859_2>cp1250": (("iso8859_2", "cp1250"),),
    "cp1250>iso8859_2": (("cp1250", "iso8859_2"),),
    "cp1252>cp1251": (("cp1252", "cp1251"),),
    "cp1252>cp1250": (("cp1252", "cp1250"),),
    "cp1252>cp437": (("cp1252", "cp437"),),
    "cp1252>cp850": (("cp1252", "cp850"),),
    "cp1252>mac_roman": (("cp1252", "mac_roman"),),
    "mac_roman>cp1252": (("mac_roman", "cp1252"),),
    "cp850>cp1252": (("cp850", "cp1252"),),
}
_NAMES = ("clean", *CHAINS)
#: Chains sure enough to keep a line out of the clean training lines; the others take
#: Western letters to Western letters or signs, of which odd but clean text has plenty.
_TELLING = {c for c in CHAINS if c.startswith("utf8") or c in (
    "cp1251>cp1252", "cp1251>koi8_r", "koi8_r>cp1251", "cp866>cp1251", "cp1250>cp1252", "iso8859_2>cp1252")}
# Chains that few words among clean ones can tell: the telling ones, and those into another alphabet.
_TELLING_RUNS = [c for c in CHAINS if not c.startswith("utf8") and (c in _TELLING or c.startswith(("koi8_r", "cp866", "cp1251")))]
_TELLING_PLACES = [(c, _NAMES.index(c)) for c in _TELLING_RUNS]
LOST = "lost bytes"

#: Fitted on besides the corpus, so that small corpora know these languages too.
PHRASES = (
    "Ich hätte gern gewußt, ob die Straße über die Brücke führt; früher war das möglich. Schöne Grüße aus Österreich – natürlich „später“.",
    "L’été dernier, l’élève a déjà reçu la clé à côté de l’hôtel : très bien, ça suffit où ? Bien sûr… « peut-être » Évidemment, même à Noël.",
    "¿Dónde está el niño? Mañana vendrá según él, quizás también más tarde. ¡Qué lástima! Así será la última página en español.",
    "Não há solução fácil: a página já não está disponível. Três opções são possíveis, então façamos à mão. É só atenção e razão.",
    "Кто-нибудь уже пробовал это сделать? После обновления всё работает очень медленно, и я не понимаю почему. Спасибо за помощь, «друг».",
    "Zażółć gęślą jaźń. Może ktoś wie, dlaczego źródło się zmieniło? Najczęściej winne są błędy, które łatwo naprawić później. Dziękuję „bardzo”.",
    "Může mi někdo říct, proč se po aktualizaci všechno tak zpomalilo? Děkuji, už jsem zkoušel úplně všechno a nevím si rady.",
    "Köszönöm, de már megpróbáltam: a frissítés után minden lassú, és nem értem, miért. Az űrlap később eltűnt, az időzítő működik.",
    "Ξέρει κανείς γιατί όλα έγιναν τόσο αργά μετά την ενημέρωση; Ευχαριστώ πολύ για τη βοήθεια, δεν καταλαβαίνω τι φταίει.",
    "Güncellemeden sonra her şey çok yavaşladı, nedenini anlamıyorum. Teşekkürler, değişiklik işe yaramadı; başka öneriniz var mı?",
    "It’s a naïve café — don’t pay €20 for it… “Really,” she said – that’s fine.",
)

#: Fitted on as words of their own: what they turn into is often all that is garbled.
ALONE = ("\u00a0", "\u200b", "\ufeff", *"°£€§©®™→✓✔✗★♥😀😂😉🙂😊🤔👍🙏🎉🚀", "❤️")

# Code marks: fenced and inline spans, and code or pre elements.
_OPEN = re.compile(r"(?P<fence>```|~~~)|<(?P<tag>pre|code|samp|kbd|tt)\b[^<>]*>|(?P<ticks>`+)", re.I)
_CLOSE = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in ("pre", "code", "samp", "kbd", "tt")}
_TICKS = re.compile("`+")
_BLANK_LINE = re.compile(r"\n[ \t\r\f\v]*\n")
_TOKEN = re.compile(r"[^ \t\r\n\f\v]+")
_RUN = re.compile(r"[^\x00-\x7f]+")
_MIXED = re.compile("[A-Za-z\u00c0-\u017f][\u0400-\u04ff]|[\u0400-\u04ff][A-Za-z\u00c0-\u017f]")
# Typographic spaces and invisible characters are no evidence where nothing else beyond ASCII is about.
# What the inverse of a chain out of UTF-8 may hold beyond ASCII: letters of the scripts in wide use today, signs, emoji.
# Strict decoding has ruled out nearly everything else; scripts left out are those that accented
# letters before quotes or dashes look like (the end of a German or French quotation reads as NKo or IPA).
_WRITTEN = re.compile("[\u00a0-\u017f\u018f\u0192\u01a0\u01a1\u01af\u01b0\u01cd-\u01dc\u0218-\u021b\u0259\u02b0-\u02ff\u0300-\u036f\u0370-\u052f\u0531-\u058a\u05d0-\u05f4\u0600-\u06ff\u0900-\u0dff\u0e00-\u0eff"
                      "\u10a0-\u11ff\u1e00-\u206f\u2070-\u2bff\u2e80-\ua4cf\uac00-\ud7af\uf900-\ufaff\ufb00-\ufb06\ufb50-\ufdff\ufe00-\ufe0f\ufe30-\ufeff"
                      "\uff00-\uffef\U0001f000-\U0001faff\U00020000-\U0003134f\U000e0020-\U000e007f]")
# The other chains decode anything, so only letters of their scripts and the usual signs of prose tell.
_PROSE = re.compile("[\u00a1\u00a2\u00a3\u00a5\u00a7\u00a9\u00aa\u00ab\u00ae\u00b0-\u00b3\u00b5\u00b7\u00b9-\u00ff\u0100-\u017f\u0218-\u021b\u0400-\u045f\u0490\u0491"
                    "\u2010-\u2015\u2018-\u201e\u2022\u2026\u2032\u2033\u20ac\u2116\u2122]")
_SIGN_IN_WORD = re.compile(r"[^\W\d_][^\w\x00-\x7f\u00b7\u2010-\u2015\u2019][^\W\d_]")
# Branches of file trees, which single-byte chains take for capitals; no evidence by themselves.
_TREE = re.compile("[\u2500\u2502\u250c\u2510\u2514\u2518\u251c\u2524\u252c\u2534\u253c]+")
_CYRILLIC = re.compile("[\u0400-\u04ff]")
_BLANK = re.compile("[\u00a0\u00ad\u2000-\u200f\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]")


def _readable(c: str, usual: re.Pattern[str]) -> bool:
    """Whether a character is ASCII or an assigned one that ``usual`` has; controls and unpaired surrogates never are."""
    return c <= "\x7f" or (usual.match(c) is not None and unicodedata.category(c) not in ("Cc", "Cn", "Co", "Cs"))


# Character references, numeric or named; none holds white space, so words stay words when they are read.
_REFERENCE = re.compile(r"&(?:#(?P<dec>[0-9]{1,7})|#[xX](?P<hex>[0-9a-fA-F]{1,6})|(?P<named>[A-Za-z][A-Za-z0-9]{1,31}));")
#: Texts that may hold anything beyond ASCII, as it stands or as a character reference.
_CANDIDATE = r"[^\x00-\x7F]|&(#[0-9xX]|[A-Za-z][A-Za-z0-9]*;)"


def _referred(m: re.Match[str]) -> str:
    """What a reference stands for, if that is beyond ASCII; else the reference itself."""
    if m["named"]:
        c = html5.get(m["named"] + ";", "")
    else:
        code = int(m["dec"]) if m["dec"] else int(m["hex"], 16)
        c = chr(code) if code <= 0x10FFFF and not 0xD800 <= code <= 0xDFFF else ""
    return c if c and not c.isascii() else m.group()


def read_references(text: str) -> str:
    """``text`` with its character references read, as far as they stand for what is beyond ASCII."""
    return _REFERENCE.sub(_referred, text) if "&" in text else text


def tokens_of(line: str) -> list[str]:
    """Words with letters or signs beyond ASCII."""
    return [t for t in _TOKEN.findall(line) if not t.isascii() and not _BLANK.sub("", t).isascii()]



def _tables() -> tuple[dict[str, dict[int, str]], dict[str, dict[str, int]]]:
    """Byte to character and back for the single-byte encodings; undefined bytes stand for themselves."""
    forward: dict[str, dict[int, str]] = {}
    back: dict[str, dict[str, int]] = {}
    for name in {e for steps in CHAINS.values() for step in steps for e in step} - {"utf-8"}:
        table = {}
        for b in range(256):
            try:
                table[b] = bytes([b]).decode(name)
            except UnicodeDecodeError:
                table[b] = chr(b)
        forward[name] = table
        back[name] = {chr(b): b for b in range(128, 160)} | {c: b for b, c in table.items()}
    # the two are told apart by few bytes only, so each takes the other's characters too
    back["cp1252"] = {chr(b): b for b in range(128, 256)} | back["cp1252"]
    back["latin-1"] = back["cp1252"] | back["latin-1"]
    return forward, back


_FORWARD, _BACK = _tables()


def _encode(text: str, name: str) -> bytes | None:
    if name == "utf-8":
        try:
            return text.encode("utf-8")
        except UnicodeEncodeError:
            return None
    table = _BACK[name]
    out = [table.get(c) for c in text]
    return None if None in out else bytes(out)  # type: ignore[arg-type]


def _decode(data: bytes, name: str) -> str | None:
    if name == "utf-8":
        try:
            return data.decode("utf-8")
        except UnicodeDecodeError:
            return None
    table = _FORWARD[name]
    return "".join([table[b] for b in data])


def garble(text: str, chain: str) -> str | None:
    """``text`` as it comes out of a chain; null if it cannot be written in the chain's encodings."""
    for written, read in CHAINS[chain]:
        data = _encode(text, written)
        if data is None:
            return None
        decoded = _decode(data, read)
        assert decoded is not None
        text = decoded
    return text


def invert(text: str, chain: str) -> str | None:
    """The original of ``text`` under a chain, by strict decoding; null if there is none."""
    for written, read in reversed(CHAINS[chain]):
        data = _encode(text, read)
        if data is None:
            return None
        decoded = _decode(data, written)
        if decoded is None:
            return None
        text = decoded
    return text


def _grams(token: str) -> np.ndarray:
    """Hash buckets of the byte bigrams of a token, ends marked."""
    data = np.frombuffer(b" " + token.encode("utf-8", "surrogatepass") + b" ", dtype=np.uint8).astype(np.int64)
    pair = data[:-1] * 256 + data[1:]
    # bigrams of ASCII alone say nothing about encodings
    pair = pair[(data[:-1] > 127) | (data[1:] > 127)]
    return (pair * 40_503) % BUCKETS if BUCKETS < 65_536 else pair


@dataclass
class Model:
    """Multinomial naive Bayes: log-likelihoods per class and bucket."""

    weights: np.ndarray  # bucket x class
    prior: np.ndarray

    def score(self, token: str) -> np.ndarray:
        return self.weights[_grams(token)].sum(axis=0)


def code_spans(text: str) -> Iterator[tuple[int, int]]:
    """Start and end of what lies inside code marks, marks included.

    An inline span ends within its paragraph; a mark that nothing closes opens
    no span, whatever follows it.
    """
    at, unclosed, stop = 0, set(), -1
    while (m := _OPEN.search(text, at)) is not None:
        at, end = m.end(), -1
        if (fence := m["fence"]) is not None:
            if fence not in unclosed:
                end = text.find(fence, at)
                if end < 0:
                    unclosed.add(fence)
                else:
                    end += len(fence)
            if end < 0:
                if fence == "~~~":
                    continue
                m = _TICKS.match(text, m.start())  # may be inline marks of that many signs
                at = m.end()
        elif (tag := (m["tag"] or "").lower()):
            if tag not in unclosed:
                closed = _CLOSE[tag].search(text, at)
                if closed is None:
                    unclosed.add(tag)
                else:
                    end = closed.end()
            if end < 0:
                continue
        if end < 0:
            if stop < at:
                blank = _BLANK_LINE.search(text, at)
                stop = blank.start() if blank is not None else len(text)
            end = next((t.end() for t in _TICKS.finditer(text, at, stop) if len(t.group()) == len(m.group())), -1)
            if end < 0:
                continue
        yield m.start(), end
        at = end


def prose(text: str) -> str:
    """``text`` with code spans blanked out; offsets and lines stay."""
    if "`" not in text and "<" not in text and "~~~" not in text:
        return text
    out, at = [], 0
    for a, z in code_spans(text):
        out += text[at:a], re.sub(r"[^\n]", " ", text[a:z])
        at = z
    return "".join([*out, text[at:]])


def _suspicious(token: str) -> bool:
    """Whether some chain out of UTF-8 explains a run of the token strictly; such rows do not teach clean text."""
    for run in _RUN.findall(token):
        if "�" in run or any("\x80" <= c <= "\x9f" for c in run):
            return True
        if len(run) > 1:
            for chain in ("utf8>cp1252", "utf8>cp437", "utf8>cp850", "utf8>mac_roman", "utf8>cp1251", "utf8>cp1250", "utf8>koi8_r", "utf8>cp866"):
                back = invert(run, chain)
                if back is not None and all(_european(c) for c in back) and len(back) < len(run):
                    return True
    return False


def _european(c: str) -> bool:
    """Characters that European prose is written with."""
    return "¡" <= c <= "ſ" or "Ѐ" <= c <= "ӿ" or "‐" <= c <= "₿" or "─" <= c <= "╿"


def fit(texts: Sequence[str]) -> Model:
    """Train on clean lines and their synthetic garblings, chain by chain.

    Lines that a chain explains strictly are taken as garbled already and left
    out.  A first model, fitted so, then also drops lines it takes for garbled
    (single-byte chains decode anything), and the second is the result.
    """
    lines = [line for t in texts for line in prose(t or "").split("\n")]
    lines = [line for line in lines if not line.isascii()]
    lines = [line for line in lines if not any(_suspicious(t) for t in tokens_of(line))]
    model = _fit(list(PHRASES) * 3)
    for _ in range(2):
        detector = Detector(model)
        kept = [line for line in lines if detector.chain_of_line(line) not in _TELLING]
        model = _fit(list(PHRASES) * 3 + kept)
    return model


def _fit(lines: Sequence[str]) -> Model:
    counts = np.full((BUCKETS, len(_NAMES)), 0.02)
    tokens: dict[str, int] = defaultdict(int)
    for line in lines:
        for t in _TOKEN.findall(line):
            if not t.isascii():
                tokens[t] += 1
    for t in ALONE:
        tokens[t] += 5
    for t, n in tokens.items():
        weight = min(n, 20)
        np.add.at(counts, (_grams(t), 0), weight)
        for k, chain in enumerate(CHAINS, 1):
            bad = garble(t, chain)
            if bad is not None and bad != t and not bad.isascii():
                np.add.at(counts, (_grams(bad), k), weight)
    weights = np.log(counts / counts.sum(axis=0)).astype(np.float32)
    prior = np.full(len(_NAMES), np.log((1 - CLEAN_PRIOR) / len(CHAINS)))
    prior[0] = np.log(CLEAN_PRIOR)
    return Model(weights, prior)


class Detector:
    """Applies a model to texts; remembers the scores of tokens it has seen."""

    def __init__(self, model: Model, memory: int = 200_000) -> None:
        self.model, self.memory, self.seen = model, memory, {}
        self.alone: dict[str, str | None] = {}

    def score(self, token: str) -> np.ndarray:
        held = self.seen.get(token)
        if held is None:
            if len(self.seen) >= self.memory:
                self.seen.clear()
            held = self.seen[token] = self.model.score(token)
        return held

    def readable(self, text: str, chain: str = "utf8") -> bool:
        """Whether every character is one that the originals of a chain are written with and no word mixes alphabets.

        A fixed rule by script and category: what is found does not depend on the sample the model was fitted on.
        """
        usual = _WRITTEN if chain.startswith("utf8") else _PROSE
        if usual is _PROSE and _SIGN_IN_WORD.search(text):
            return False
        return all(_readable(c, usual) for c in text) and not _MIXED.search(text)

    def restore_token(self, token: str, chain: str) -> str | None:
        """The token's original, whole or run by run; null unless some run decodes strictly to readable text."""
        whole = invert(token, chain)
        if chain not in _TELLING and _BLANK.search(token):
            return None
        if chain not in _TELLING and whole is not None and token.isupper() and not _CYRILLIC.search(whole) and (
                not whole.isupper() or sum(map(str.isalpha, whole)) < sum(map(str.isalpha, token))):
            return None  # Western letters for Western letters or signs: a word in capitals is one as it stands
        if whole is not None and whole != token and self.readable(whole, chain):
            return whole
        if not chain.startswith("utf8"):
            return None  # any run decodes; only whole words can tell
        changed = False

        def one(m: re.Match) -> str:
            nonlocal changed
            back = invert(m.group(), chain)
            if back is not None and back != m.group() and self.readable(back, chain):
                changed = True
                return back
            return m.group()

        out = _RUN.sub(one, token)
        return out if changed else None

    def chain_of_tokens(self, tokens: Sequence[str]) -> str | None:
        """The chain that garbled the tokens, or null if they are clean."""
        total = self.model.prior.copy()
        for t in tokens:
            total = total + self.score(t)
        best: tuple[float, str] | None = None
        least = total[0] + MARGIN
        if total.max() < least:
            return None
        for k in np.argsort(-total).tolist():
            if k == 0 or total[k] < least:
                break
            chain = _NAMES[k]
            restored = [(t, self.restore_token(t, chain)) for t in tokens]
            good = [(t, r) for t, r in restored if r is not None and (chain.startswith("utf8") or not _TREE.fullmatch(t))]
            if not good:
                continue
            # the original must read as clean text, better than what is there
            gain = sum(float(self.score(r)[0]) if not r.isascii() else 0.0 for _, r in good) - sum(float(self.score(t)[0]) for t, _ in good)
            if gain > MARGIN and (chain.startswith("utf8") or 2 * len(good) >= len(tokens)):
                # of chains about as likely, the one whose original reads best
                if best is None:
                    least = max(least, total[k] - MARGIN)
                if best is None or gain > best[0]:
                    best = gain, chain
        return best and best[1]

    def chain_of_token(self, token: str) -> str | None:
        """``chain_of_tokens`` of one token, remembered."""
        if token in self.alone:
            return self.alone[token]
        if len(self.alone) >= self.memory:
            self.alone.clear()
        chain = self.alone[token] = self.chain_of_tokens([token])
        return chain

    def chain_of_line(self, line: str) -> str | None:
        """The chain of a line or, failing that, of one of its tokens or of a run of garbled ones."""
        tokens = tokens_of(line)
        if not tokens:
            return None
        chain = self.chain_of_tokens(tokens)
        if chain is None and len(tokens) > 1:
            for t in tokens:
                if len(t) > 1 and (c := self.chain_of_token(t)) is not None and c.startswith("utf8"):
                    return c
            return self.chain_of_runs(tokens)
        return chain

    def chain_of_runs(self, tokens: Sequence[str]) -> str | None:
        """The single-byte chain that garbled some adjacent tokens among clean ones, by the evidence asked of a line."""
        scores = np.array([self.score(t) for t in tokens])
        best: tuple[float, str] | None = None
        ahead = scores > scores[:, :1]
        seen = ahead.any(axis=0).tolist()
        for name, k in _TELLING_PLACES:
            if not seen[k]:
                continue
            likelier = ahead[:, k].tolist()
            start = 0
            while start < len(tokens):
                end = start
                while end < len(tokens) and likelier[end]:
                    end += 1
                if end > start and end - start < len(tokens):
                    gain = float((scores[start:end, k] - scores[start:end, 0]).sum() + self.model.prior[k] - self.model.prior[0])
                    if gain >= MARGIN and (best is None or gain > best[0]) and self.chain_of_tokens(tokens[start:end]) == name:
                        best = gain, name
                start = end + 1
        return best and best[1]

    def inspect(self, text: str) -> tuple[str, bool, str] | None:
        """``(chains, restorable, restored text)`` of a garbled text, null for a clean one.

        Character references count as what they stand for; those in words that
        are not garbled stay references in the restored text.
        """
        visible = prose(text)
        if visible.isascii() and "&" not in visible:
            return None
        chains: dict[str, int] = {}
        lost = False
        of_line: dict[int, str] = {}
        for i, line in enumerate(visible.split("\n")):
            line = read_references(line)
            if line.isascii():
                continue
            if "�" in line:
                lost = True
            elif (chain := self.chain_of_line(line)) is not None:
                chains[chain] = chains.get(chain, 0) + 1
                of_line[i] = chain
        if not chains and not lost:
            return None
        restored, open_runs = [], False
        main = max(chains, key=lambda c: chains[c]) if chains else None
        for i, line in enumerate(text.split("\n")):
            chain = of_line.get(i)
            if chain is None and main is not None and main.startswith("utf8") and not read_references(line).isascii():
                chain = main  # code inside a garbled text went the same way
            if chain is not None:
                k = _NAMES.index(chain)
                tokens = tokens_of(read_references(line))
                open_runs = open_runs or i in of_line and any(self.score(t)[k] - self.score(t)[0] > MARGIN and self.restore_token(t, chain) is None for t in tokens)
                # of a line that is garbled in part, and by a chain that decodes anything, only the words that look it
                partly = not chain.startswith("utf8") and self.chain_of_tokens(tokens) != chain

                def original(m: re.Match[str]) -> str:
                    token = read_references(m.group())
                    if token.isascii() or partly and self.score(token)[k] <= self.score(token)[0]:
                        return m.group()
                    return self.restore_token(token, chain) or m.group()

                line = _TOKEN.sub(original, line)
                after = read_references(line)
                open_runs = open_runs or not self.readable(_BLANK.sub("", after)) or self.chain_of_line(after) is not None
            restored.append(line)
        if lost:
            chains[LOST] = 1
        return "; ".join(sorted(chains)), not lost and not open_runs, "\n".join(restored)


_OUT = "doc_id bigint, chain string, restorable boolean, restored_text string"


def _inspect(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        detector = Detector(model)
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if text and (r := detector.inspect(text)) is not None:
                    rows.append((doc, *r))
            columns = list(zip(*rows)) if rows else [[]] * 4
            types = (pa.int64(), pa.string(), pa.bool_(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "chain", "restorable", "restored_text"])
    return run


def train(documents: DataFrame, rows: int = TRAIN_ROWS, seed: int = 5) -> Model:
    """Fit on at most ``rows`` texts, those with the smallest hashes, so that any layout gives the same model."""
    drawn = F.pmod(F.xxhash64(F.lit(seed), "text"), F.lit(1 << 30))
    texts = documents.where(F.col("text").rlike(r"[^\x00-\x7F]")).select("text", drawn.alias("h"))
    total = texts.count()
    if total > rows:
        # a threshold that rather more than ``rows`` hashes lie below keeps what tasks send bounded
        share = (rows + 6 * math.sqrt(rows)) / total
        texts = texts.where(F.col("h") < int(share * (1 << 30)))
    return fit(sorted(r[0] for r in texts.orderBy("h", "text").limit(rows).collect()))


def find_garbled(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """Documents with garbled sequences, and their originals where they can be had.

    Result: ``doc_id``, ``chain`` (the encoding chains found, ``lost bytes``
    for replacement characters), ``restorable``, ``restored_text``.

    Code spans are not looked at, unless the text around them is garbled.  Line
    by line, a multinomial classifier over hashed byte bigrams names the chain
    and the text is inverted along it; a line counts only if the inverse
    decodes strictly and reads as clean text.  Character references are read
    first, so what they spell counts in ASCII texts too.  Null and empty texts
    are clean, and so are ASCII ones without references.  The classifier is fitted on a bounded sample; everything else
    covers all texts, whole, whatever their length.
    """
    fitted = model or train(documents)
    # the JVM leaves out what cannot be garbled: texts with nothing beyond ASCII, spelled out or referred to
    texts = spread(documents.where(F.col("text").rlike(_CANDIDATE)).select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return texts.mapInArrow(_inspect(fitted), _OUT)
