"""Page boilerplate mixed with main content (problem 3): a linear-chain CRF over the page's leaf blocks.

Labelled pages come from the archive itself: pages whose markup names their parts (``main`` or ``article`` beside
``nav``, ``aside``, ``footer``) tell which blocks are their own. Each such page is also learnt with its telling tags
replaced by ``div`` and as plain text, so that the model does not lean on them. The fitted model is a few hundred
weights; pages are decoded by Viterbi in one narrow pass, without any shuffle.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from functools import cache, lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archivolt.llm import crf
from archivolt.llm.pages import Block, blocks_of, kind_of

#: Labelled pages in training at most, and characters of the longest one: the bound of what the driver reads.
TRAIN_PAGES, TRAIN_CHARS = 300, 50_000

#: Words by which sites mark what is theirs, in the languages of the archive.
LEXICON = {
    "cookie": r"\bcookies?\b|consent|privacy matters|small files on your device|welche daten gespeichert|données.*appareil|datos.*guardar|vie privée nous|proteger su privacidad",
    "legal": r"©|\(c\) \d{4}|\ball rights reserved|privacy policy|terms of (?:use|service)|\bimprint\b|accessibility|made with care|mentions légales|vie privée|tous droits|plan du site|impressum|datenschutz|nutzungsbedingungen|alle rechte|aviso legal|privacidad|todos los derechos|mapa del sitio|condiciones|conditions d.utilisation",
    "share": r"^(?:share|partager|teilen|compartir)\b.{0,80}(?:print|imprimer|drucken|imprimir)",
    "pager": r"^(?:previous|précédent|zurück|anterior)\W+(?:next|suivant|weiter|siguiente)$",
    "related": r"^(?:related|most read|you may also|recent comments|tags|follow us|subscribe|see also|read (?:also|next)|more from|trending|à lire aussi|les plus lus|recevoir|suivez|mots.clés|derniers commentaires|ähnliche|meistgelesen|am meisten|rundbrief|schlagwörter|folgen sie|neueste kommentare|das könnte|páginas parecidas|lo más|síganos|suscr|boletín|etiquetas|comentarios recientes|también|recibir|te puede|sur le même)\b",
    "crumb": r"^(?:you are here|vous êtes ici|sie sind hier|usted está|está usted|está aquí|estás aquí)\b",
    "skip": r"^(?:skip to|aller au|zum inhalt|saltar al|ir al contenido)",
    "button": r"\b(?:accept all|only necessary|got it|tout accepter|refuser|réglages|alle zulassen|nur notwendige|einstellungen|aceptar|ajustes|rechazar|solo lo necesario)\b",
    "script": r"(?:javascript|scripts?|skripte)\b",
    "menu": r"^[-*•] \S+(?: \S+){0,2}$",
    "menuline": r"^\S+(?: \S+){0,2}(?:(?: [>*|·/] |  +)\S+(?: \S+){0,2}){2,}$",
    "copyright": r"^(?:©|\(c\)|copyright)",
}
_LEXICON = {k: re.compile(v, re.IGNORECASE) for k, v in LEXICON.items()}
#: Literals of which every match of a pattern that may stand anywhere holds one.
_HINTS = (
    "cookie", "consent", "privacy", "small files", "gespeichert", "données", "datos", "vie privée", "privacidad", "©", "(c)", "all rights", "terms of", "imprint", "accessibility", "made with care",
    "mentions légales", "tous droits", "plan du site", "impressum", "datenschutz", "nutzungsbedingungen", "alle rechte", "aviso legal", "todos los derechos", "mapa del sitio", "condiciones", "conditions d",
    "accept all", "only necessary", "got it", "accepter", "refuser", "réglages", "alle zulassen", "nur notwendige", "einstellungen", "aceptar", "ajustes", "rechazar", "solo lo necesario", "script", "skripte",
)
#: The patterns that hold at the start of a block only.
_AT_START = re.compile("|".join(f"(?:{v})" for v in LEXICON.values() if v.startswith("^")), re.IGNORECASE)
_PARTS = ("nav", "header", "footer", "aside", "main", "article", "noscript", "form", "head", "table", "ul", "ol", "section")
_NEAR = ("related", "legal", "cookie", "share", "pager", "crumb", "menu", "menuline", "button", "copyright")


def _bin(n: float, edges: tuple[float, ...]) -> int:
    return bisect_left(edges, n)


def groups(blocks: list[Block], kind: str) -> list[int]:
    """The block's neighbourhood: in a page the innermost grouping element that holds more than this block, in plain
    text its run of lines without a blank one."""
    if kind == "html":
        held: dict[int, int] = {}
        for b in blocks:
            for n in b.chain:
                held[n] = held.get(n, 0) + 1
        return [next((n for n in reversed(b.chain) if held[n] > 1), 0) for b in blocks]
    out, g = [], 0
    for i, b in enumerate(blocks):
        g += i > 0 and b.lines[0] > blocks[i - 1].lines[-1] + 1
        out.append(g)
    return out


def page_title(blocks: list[Block]) -> str:
    return next((b.text for b in blocks if b.tag == "title"), "")


def body(blocks: list[Block]) -> list[Block]:
    """The blocks outside the document's head."""
    return [b for b in blocks if b.tag != "title" and "head" not in b.path]


@cache
def _hints():
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for hint in _HINTS:
        automaton.add_word(hint, True)
    automaton.make_automaton()
    return automaton


def text_features(text: str) -> set[str]:
    """The observations that a block's text alone gives."""
    n = len(text)
    f = {f"len={_bin(n, (12, 30, 60, 120, 240))}", f"words={_bin(text.count(' ') + 1, (1, 3, 7, 15))}", f"end={text[-1] if text[-1] in '.!?:,;' else '-'}"}
    if _AT_START.match(text) or next(_hints().iter(text.lower()), None):
        f.update(f"word={k}" for k, rx in _LEXICON.items() if rx.search(text))
    if text[0] in "-*•":
        f.add("bullet")
    if text[0].islower():
        f.add("lower")
    return f


@lru_cache(maxsize=10_000)
def _parts_in(path: tuple[str, ...]) -> tuple[str, ...]:
    return tuple(f"in={t}" for t in _PARTS if t in path)


@lru_cache(maxsize=10_000)
def _seen_from_beside(names: frozenset[str]) -> tuple[str, ...]:
    return tuple(sorted(x for x in names if x.startswith(("tag=", "link=", "len=")) or x.startswith("word=") and x[5:] in _NEAR))


#: What neighbours see, numbered, since the numbers are looked up for every block.
_SEEN: list[tuple[str, ...]] = []
_NUMBERS: dict[tuple[str, ...], int] = {}


def _number(seen: tuple[str, ...]) -> int:
    number = _NUMBERS.setdefault(seen, len(_SEEN))
    if number == len(_SEEN):
        _SEEN.append(seen)
    return number


class Own:
    """What a block shows by itself: the names of its observations, those that its neighbours see, and marks that
    its neighbourhood looks for."""

    __slots__ = ("names", "beside", "related", "small", "copyright", "buttons", "linked", "furniture")

    def __init__(self, b: Block) -> None:
        n, f = len(b.text), text_features(b.text)
        f.update((f"tag={b.tag}", f"link={0 if not b.linked else _bin(b.linked / n, (0.5, 0.9)) + 1}", f"links={_bin(b.links, (0, 1))}"))
        f.update(_parts_in(b.path))
        if b.buttons:
            f.add("buttons")
        if b.bold * 10 > n * 9:
            f.add("bold")
        self.names = frozenset(f)
        self.beside = _number(_seen_from_beside(self.names))
        self.related, self.small, self.copyright = "word=related" in f, not f.isdisjoint(("tag=h3", "tag=h4", "bold")), "word=copyright" in f
        self.buttons, self.linked = not f.isdisjoint(("buttons", "word=button")), not f.isdisjoint(("link=3", "word=menu"))
        self.furniture = not f.isdisjoint(("word=cookie", "word=crumb", "word=menuline", "word=legal"))


#: Blocks remembered at most, and characters of the longest remembered: sites repeat their furniture on every page.
REMEMBERED, REMEMBERED_CHARS = 50_000, 200


class Memory(dict):
    """A cache that starts anew when it is full."""

    def keep(self, key, value):
        if len(self) >= REMEMBERED:
            self.clear()
        self[key] = value
        return value


_OWN = Memory()


def _own(b: Block) -> Own:
    if len(b.text) > REMEMBERED_CHARS:
        return Own(b)
    key = (b.text, b.tag, b.path, b.linked, b.links, b.buttons > 0, b.bold)
    return _OWN.get(key) or _OWN.keep(key, Own(b))


def observe(blocks: list[Block], kind: str, title: str = "") -> list[tuple]:
    """Each block as five atoms: itself, its neighbourhood, its place, and what stands before and behind it. An
    atom's observations are named by :func:`names_of`; atoms recur, so a model scores each of them once."""
    group = groups(blocks, kind)
    members: dict[int, list[int]] = {}
    for i, g in enumerate(group):
        members.setdefault(g, []).append(i)
    own = [_own(b) for b in blocks]
    headings = [i for i, b in enumerate(blocks) if b.tag == "h1"] or [i for i, b in enumerate(blocks) if len(b.text) > 7 and title.startswith(b.text)]
    heading_set = set(headings)
    shared: dict[int, tuple] = {}
    for g, mates in members.items():
        lead = own[mates[0]]
        shared[g] = (
            kind, _bin(len(mates), (1, 2, 5)), lead.related, lead.small, mates[0] in heading_set, any(own[j].copyright for j in mates),
            not heading_set.isdisjoint(mates), any(own[j].buttons for j in mates), all(own[j].linked for j in mates),
        )
    last = len(blocks) - 1
    titled = any(b.tag == "line" and len(b.text) > 40 for b in blocks)
    first_text = next((i for i, b in enumerate(blocks) if len(b.text) > 40 and not own[i].furniture), last + 1)
    after_related = False
    out = []
    for i, b in enumerate(blocks):
        g, text, gap = group[i], "", ""
        if kind == "text":
            after_related = after_related or shared[g][2]
            text = "before text" if i < first_text else "at text" if i == first_text else "after text"
            gap = f"gap={int(i > 0 and g != group[i - 1])}{int(i < last and g != group[i + 1])}"
        head = "no h1" if not headings else "at h1" if i in heading_set else "before h1" if i < headings[0] else "after h1"
        place = (after_related, head, text, gap, min(i, 3), min(last - i, 3), titled, head == "at h1" and b.tag != "h1")
        out.append((
            own[i], shared[g], place,
            ("prev:", own[i - 1].beside, group[i - 1] == g) if i else ("prev:", None, False),
            ("next:", own[i + 1].beside, group[i + 1] == g) if i < last else ("next:", None, False),
        ))
    return out


_SHARED = ("led=related", "led=small", "led=h1", "with copyright", "with h1", "with buttons", "all links")


def names_of(atom) -> list[str]:
    """The names of an atom's observations."""
    if isinstance(atom, Own):
        return list(atom.names)
    if len(atom) == 3:
        side, beside, same = atom
        return [side + "none"] if beside is None else [*(side + x for x in _SEEN[beside]), side + ("same" if same else "other")]
    if len(atom) == 9:
        return ["bias", f"kind={atom[0]}", f"mates={atom[1]}", *(n for n, held in zip(_SHARED, atom[2:], strict=True) if held)]
    after_related, head, text, gap, first, last, titled, title_text = atom
    marks = (("behind related", after_related), (text, text), (gap, gap), (f"first={first}", first < 3), (f"last={last}", last < 3), ("long lines", titled), ("title text", title_text))
    return [head, *(n for n, held in marks if held)]


def features(blocks: list[Block], kind: str, title: str = "") -> list[set[str]]:
    """The observations of each block: tags, text, neighbourhood, and what its neighbours look like."""
    return [{n for atom in atoms for n in names_of(atom)} for atoms in observe(blocks, kind, title)]


class Reader:
    """A model with the scores of the atoms met so far."""

    def __init__(self, model: crf.Model) -> None:
        self.model, self.scores = model, Memory()

    def labels(self, blocks: list[Block], kind: str, title: str) -> list[int]:
        scores, weights, totals = self.scores, self.model.weights, []
        for atoms in observe(blocks, kind, title):
            total = 0.0
            for atom in atoms:
                score = scores.get(atom)
                if score is None:
                    score = scores.keep(atom, sum([weights[n] for n in names_of(atom) if n in weights]))
                total += score
            totals.append(total)
        return self.model.best_path(totals)


def labelled(payload: str) -> tuple[list[Block], list[int]] | None:
    """The blocks and labels of a page whose markup names its parts; None for any other page."""
    if kind_of(payload) != "html":
        return None
    blocks = blocks_of(payload, "html")
    if not any("main" in b.path or "article" in b.path for b in blocks):
        return None
    labels = []
    for b in blocks:
        inside = ("main" in b.path or "article" in b.path) and not {"nav", "aside", "footer", "form", "noscript", "head"} & set(b.path)
        row = b.links > 1 and b.linked * 10 > 6 * len(b.text) or bool(_LEXICON["share"].search(b.text))
        box = b.tag == "div" and b.links > 0 or bool(_LEXICON["related"].search(b.text)) and b.bold > 0
        labels.append(int(inside and not row and not box and b.tag != "title"))
    return blocks, labels


def _plainer(blocks: list[Block], style: str) -> list[Block]:
    """The page with its telling tags replaced: ``soup`` by ``div``; ``divs`` also headings and paragraphs; ``table``
    in the manner of old layout tables, where text stands in cells."""
    parts = ("nav", "header", "footer", "aside", "main", "article", "section")
    flat = ("h1", "p", "blockquote") if style != "soup" else ()
    new = "td" if style == "table" else "div"
    out = []
    for n, b in enumerate(blocks):
        own = "main" in b.path or "article" in b.path
        kept = b.tag == "p" and b.links > 0  # stays a paragraph
        path = []
        for t in b.path:
            if t in parts:
                path += ["table", "tr", "td"] if style == "table" and t != "aside" else ["div"]
            elif kept or not (own and t in flat):
                path.append(t)
        tag, chain, bold = b.tag, b.chain, b.bold
        if own and tag in flat and not kept:
            if style == "table":
                bold = len(b.text) if tag == "h1" else bold
            elif tag != "blockquote":
                path.append("div")
                chain = (*chain, -1 - n)
            tag = new
        elif tag in parts:
            tag = new if tag != "aside" else "div"
        out.append(Block(b.text, b.lines, tag, tuple(path), b.linked, b.buttons, bold, b.links, chain))
    return out


def _as_text(blocks: list[Block], labels: list[int], rng: random.Random) -> tuple[list[Block], list[int]]:
    """The page as plain text, in one of the ways in which pages are turned to text."""
    style = rng.choice(("bullets", "joined", "bare"))
    wrap, chrome, spaced = rng.random() < 0.4, rng.random() < 0.75, rng.random() < 0.7
    point = rng.choice(("", "* ", "- "))
    lines: list[tuple[str, int] | None] = []
    menu: list[str] = []
    row: list[str] = []

    def flush_menu() -> None:
        if menu:
            lines.extend([(rng.choice((" > ", " * ", " | ", " · ", "  ")).join(menu), 0)] if style == "joined" else [((rng.choice(("- ", "* ", "")) if style == "bullets" else "") + x, 0) for x in menu])
        menu.clear()

    foot: list[str] = []
    previous = 0
    for i, (b, y) in enumerate(zip(blocks, labels, strict=True)):
        if b.tag in ("title", "noscript") or (not y and not chrome) or _LEXICON["skip"].search(b.text):
            continue
        if row and b.tag not in ("td", "th"):
            lines.append((" ".join(row), 1))
            row.clear()
        if "nav" in b.path or (not y and b.tag in ("li", "ul") and "aside" not in b.path):
            menu.extend([b.text] if b.tag in ("li", "a") else b.text.split(" ") if b.links > 1 else [b.text])
            continue
        flush_menu()
        if y != previous and spaced:
            lines.append(None)
        previous = y
        if "footer" in b.path:
            if len(b.text) > 45:
                lines.append((b.text, 0))
            else:
                foot.append(b.text.replace(" · ", " "))
            continue
        if b.tag in ("td", "th"):
            row.append(b.text)
            if i + 1 < len(blocks) and blocks[i + 1].path != b.path:
                continue
            if len(row) >= 3:
                lines.append((" ".join(row), 1))
                row.clear()
            continue
        text = point + b.text if y and b.tag == "li" else b.text
        if b.links > 1 and not y:
            words = text.split(" ")
            text = rng.choice((" | ", " ")).join(words) if len(words) <= 4 else text
        if b.tag in ("h1", "h2", "h3") and y and spaced:
            lines.append(None)
        if wrap and y and len(text) > 75:
            at = ""
            for w in text.split(" "):
                if at and len(at) + len(w) > 71:
                    lines.append((at, y))
                    at = w
                else:
                    at = f"{at} {w}" if at else w
            lines.append((at, y))
        else:
            lines.append((text, y))
        if y and spaced and b.tag in ("h1", "p", "blockquote"):
            lines.append(None)
    if row:
        lines.append((" ".join(row), 1))
    flush_menu()
    if foot and chrome:
        lines.append((". ".join(foot[:1]) + ". " + " ".join(foot[1:]), 0))
    out, y = [], []
    for n, x in enumerate(lines):
        if x and x[0].strip():
            out.append(Block(x[0].strip(), [n], "line", ()))
            y.append(x[1])
    return out, y


def training_pages(df: DataFrame, payload_col: str, pages: int = TRAIN_PAGES) -> list[str]:
    """The labelled pages to learn from: those with the smallest payload hashes, each payload once. Only hashes are
    sorted and shuffled; the chosen payloads are fetched by them."""
    hashed = df.select(F.col(payload_col).alias("p"), F.xxhash64(payload_col).alias("h"))
    labelled_pages = hashed.where(F.col("p").rlike("(?i)<(?:main|article)\\b") & (F.length("p") <= TRAIN_CHARS))
    chosen = [r["h"] for r in labelled_pages.select("h").distinct().orderBy("h").limit(pages).collect()]
    fetched = hashed.where(F.col("h").isin(chosen)).groupBy("h").agg(F.min("p").alias("p"))
    return [r["p"] for r in sorted(fetched.collect(), key=lambda r: r["h"])]


def fit(payloads: list[str], seed: int = 7) -> crf.Model:
    """Train on labelled pages: as they are, with plain tags, and as text."""
    rng = random.Random(seed)
    sequences, labels = [], []
    for payload in payloads:
        if (page := labelled(payload)) is None:
            continue
        blocks, y = page
        title = page_title(blocks)
        y = [z for b, z in zip(blocks, y, strict=True) if b.tag != "title" and "head" not in b.path]
        blocks = body(blocks)
        for version in (blocks, _plainer(blocks, "soup"), _plainer(blocks, rng.choice(("divs", "table")))):
            sequences.append(features(version, "html", title if rng.random() < 0.8 else ""))
            labels.append(y)
        version, z = _as_text(blocks, y, rng)
        sequences.append(features(version, "text"))
        labels.append(z)
    return crf.train(sequences, labels)


def main_blocks(payload: str, model: crf.Model) -> list[Block]:
    """The blocks of the page's own text."""
    return read_page(payload, Reader(model))[0]


def read_page(payload: str, reader: Reader) -> tuple[list[Block], list[Block], str]:
    """The blocks of the page's own text, the other blocks of its body, and its title."""
    kind = kind_of(payload)
    blocks = blocks_of(payload, kind)
    title, blocks = page_title(blocks), body(blocks)
    labels = reader.labels(blocks, kind, title)
    return [b for b, y in zip(blocks, labels, strict=True) if y], [b for b, y in zip(blocks, labels, strict=True) if not y], title
