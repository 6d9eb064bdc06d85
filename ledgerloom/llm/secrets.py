"""Secret scan: fixed formats, plus tokens that a probabilistic automaton inferred from labelled credentials finds likely."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ledgerloom.llm.common import modest_batches

KINDS = ("assign", "access", "hex", "token")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
#: A maximal run of 32 or more is the same as a maximal run that has 32 or more.
HEX = re.compile(r"[0-9a-f]{32,}")
#: Runs of the base64 alphabets and the dot; `=` only as padding, else it parts a name from its value.
CANDIDATE = re.compile(r"[A-Za-z0-9+/._-]{14,}={0,2}")
#: A run that isn't likely as a whole is scored again in the pieces between these.
PARTS = (re.compile(r"[^.]+"), re.compile(r"[^./+=]+"))
SHORTEST = 16
#: How many credentials there are for each plain token, by guess.
ODDS = 1e-7
DIGIT = re.compile(r"[0-9]")
END = ""


def learned_heads(strings: list[str], least: int = 20, longest: int = 12) -> list[str]:
    """Fixed heads of the labelled credentials, longest first: beginnings of 3 or more characters that at least `least`
    of them share and that no longer shared one continues."""
    counts = Counter(s[:n] for s in strings for n in range(3, longest + 1) if len(s) > n)
    shared = {h for h, n in counts.items() if n >= least}
    whole = [h for h in shared if not any(x != h and x.startswith(h) for x in shared)]
    return sorted(whole, key=lambda h: (-len(h), h))


def symbols(token: str, heads: list[str] = []) -> list[str]:
    """A learned head is one symbol; letters by case and digits become classes; other characters stand for themselves."""
    head = next((h for h in heads if token.startswith(h)), "")
    return [head] * bool(head) + ["d" if "0" <= c <= "9" else "a" if "a" <= c <= "z" else "A" if "A" <= c <= "Z" else c for c in token[len(head) :]]


def labelled_credentials(each: int = 60, seed: int = 7) -> tuple[list[str], list[str]]:
    """Labelled strings to learn from: random bodies under well-known key layouts, and harmless long tokens."""
    rng = random.Random(seed)
    mixed = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    body = lambda n: "".join(rng.choice(mixed) for _ in range(n))
    layouts = [("ghp_", 36), ("sk_live_", 24), ("npm_", 36), ("glpat-", 20), ("AIza", 35), ("xoxb-", 24), ("hf_", 34), ("", 32), ("", 40), ("", 24)]
    secret = [head + body(n) for head, n in layouts for _ in range(each)]
    base64 = lambda n: "".join(rng.choice(mixed + "+/") for _ in range(n))
    for _ in range(each):
        secret += [body(16), body(18), base64(40), base64(40), base64(22) + "==", base64(43) + "=", base64(64), "eyJ" + body(17) + "." + body(40) + "." + body(43)]
    parts = "the of and tion ing er an on st re ha en ed nd ou th ment que eau sch ung keit".split()
    word = lambda n: "".join(rng.choice(parts) for _ in range(n))
    plain = []
    for _ in range(each * 4):
        plain += [word(9), word(5) + "-" + word(5), word(4) + "_" + word(3) + "_" + str(rng.randrange(100)), word(8) + str(rng.randrange(10_000)), str(rng.randrange(10**21, 10**22))]
        plain += [f"{rng.randrange(1990, 2030)}-{rng.randrange(10, 13)}-{rng.randrange(10, 29)}-{word(6)}", word(8).capitalize() + word(1).upper()]
    camel = lambda n: "".join(word(2).capitalize() for _ in range(n))
    for _ in range(each * 2):
        year, top = str(rng.randrange(1990, 2030)), rng.choice(("com", "org", "net"))
        plain += [f"src/{word(2)}/{word(3)}/{word(3)}_{rng.randrange(100)}.py", f"//www.{word(3)}.{top}/{word(2)}/{year}/{rng.randrange(1, 13):02}/{word(2)}-{word(3)}.html", f"/usr/{word(2)}/{word(2)}{rng.randrange(10)}/{word(3)}"]
        plain += [f"{word(4)}.{word(3)}.{word(3)}", f"{word(4)}-{rng.randrange(10)}.{rng.randrange(20)}.{rng.randrange(10)}.tar.gz", f"{word(4)}.{word(4).capitalize()}", f"{word(3)}/{word(3)}+{word(3)}", camel(4), f"{camel(3)}.{word(3)}{camel(1)}", f"{word(3)}{camel(2)}{rng.randrange(100)}"]
        plain += ["".join(rng.choice("0123456789") for _ in range(rng.randrange(16, 40))), word(12).upper(), f"{word(3).upper()}_{word(4).upper()}_{rng.randrange(10)}", f"{word(3)}_{word(3)}{year}", f"//{word(4)}.{top}/{camel(2)}/{year}", f"{word(rng.randrange(1, 3))}{rng.randrange(20)}.{word(rng.randrange(2, 5))}.{top}"]
        plain += [f"{word(rng.randrange(2, 7))}{year}{word(rng.randrange(2, 6))}", f"{word(3)}{rng.randrange(10)}{word(4)}{rng.randrange(100)}", "-".join("".join(rng.choice("0123456789abcdef") for _ in range(n)) for n in (8, 4, 4, 4, 12))]
        plain += [sign.join(word(rng.randrange(1, 4)) for _ in range(rng.randrange(3, 7))) for sign in "_-./"]
    return secret, plain


class Automaton:
    """A stochastic automaton: counts of each state's symbols (END for stopping) and of its successors."""

    def __init__(self) -> None:
        self.counts: list[dict[str, int]] = [defaultdict(int)]
        self.next: list[dict[str, int]] = [{}]

    @classmethod
    def prefix_tree(cls, strings: list[list[str]]) -> Automaton:
        tree = cls()
        for s in strings:
            at = 0
            for c in s:
                tree.counts[at][c] += 1
                if c not in tree.next[at]:
                    tree.next[at][c] = len(tree.counts)
                    tree.counts.append(defaultdict(int))
                    tree.next.append({})
                at = tree.next[at][c]
            tree.counts[at][END] += 1
        return tree

    def alike(self, a: int, b: int, bound: float) -> bool:
        """Whether the shares of two states' symbols, and those of all states they lead to, differ by no more than chance allows.

        Shares are of strings that go on, so that layouts of several lengths can share states; b is in the tree, so this ends.
        """
        n, m = (sum(k for c, k in self.counts[x].items() if c != END) for x in (a, b))
        if not n or not m:
            return True
        most = bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))
        if any(abs(self.counts[a][c] / n - self.counts[b][c] / m) > most for c in {*self.counts[a], *self.counts[b]} - {END}):
            return False
        return all(self.alike(self.next[a][c], self.next[b][c], bound) for c in self.next[a].keys() & self.next[b].keys() if self.next[a][c] != self.next[b][c])

    def fold(self, into: int, tree: int) -> None:
        """Add a subtree's counts to a state and its successors."""
        for c, k in self.counts[tree].items():
            self.counts[into][c] += k
        for c, child in self.next[tree].items():
            if c in self.next[into]:
                self.fold(self.next[into][c], child)
            else:
                self.next[into][c] = child

    def merge_states(self, confidence: float = 0.01) -> Automaton:
        """Grow a core of distinct states; each fringe state is folded into the first that it is statistically like, or joins the core."""
        bound = math.sqrt(0.5 * math.log(2 / confidence))
        core = [0]
        while True:
            fringe = next(((r, c, t) for r in core for c, t in sorted(self.next[r].items()) if t not in core), None)
            if fringe is None:
                return self
            parent, symbol, state = fringe
            twin = next((r for r in core if self.alike(r, state, bound)), None)
            if twin is None:
                core.append(state)
            else:
                self.next[parent][symbol] = twin
                self.fold(twin, state)

    def log_likelihood(self, s: list[str], floor: float = 1e-3) -> float:
        """Log probability of the whole string s, its end included; an unseen step costs log(floor) and keeps the state, an unseen head as much as that many random characters."""
        total, at = 0.0, 0
        for c in [*s, END]:
            counts = self.counts[at]
            n, seen = sum(counts.values()), counts.get(c, 0)
            least = floor if len(c) < 2 else 62.0 ** -len(c)
            total += math.log(max(seen / n, least) if n else least)
            at = self.next[at].get(c, at)
        return total


class SecretModel:
    """Automata of credentials and of plain tokens; a token's score is the log of its likelihood ratio."""

    def __init__(self, secret: list[str], plain: list[str]) -> None:
        self.heads = learned_heads(secret)
        self.secret = Automaton.prefix_tree([symbols(x, self.heads) for x in secret]).merge_states()
        self.plain = Automaton.prefix_tree([symbols(x, self.heads) for x in plain]).merge_states()
        # More likely a credential than plain, given the odds of one, and above all but 1 in 200 of the labelled plain tokens.
        good = sorted(map(self.score, plain))
        self.least = max(-math.log(ODDS), good[-1 - len(good) // 200])

    def score(self, token: str) -> float:
        s = symbols(token, self.heads)
        return self.secret.log_likelihood(s) - self.plain.log_likelihood(s)

    def likely(self, token: str) -> bool:
        return self.score(token) >= self.least


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed formats, in code points, end exclusive; leftmost non-overlapping within a kind."""
    found = []
    low = text.lower()
    if any(w in low for w in WORDS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    if DIGIT.search(text) or HEX.search(text):
        found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def method_spans(text: str, base: list[tuple[int, int, str]], model: SecretModel) -> list[tuple[int, int, str]]:
    """Every token outside base spans that the automaton finds likely to be a credential: a whole run, else its pieces between dots, else those between all signs."""
    found = []

    def search(start: int, end: int, depth: int) -> None:
        while start < end and text[start] == ".":
            start += 1
        while start < end and text[end - 1] == ".":
            end -= 1
        if end - start < SHORTEST:
            return
        if not any(s < end and start < e for s, e, _ in base) and model.likely(text[start:end]):
            found.append((start, end, "token"))
        elif depth < len(PARTS):
            for m in PARTS[depth].finditer(text, start, end):
                search(m.start(), m.end(), depth + 1)

    for m in CANDIDATE.finditer(text):
        search(m.start(), m.end(), 0)
    return found


def scan_secrets(docs: DataFrame, model: SecretModel | None = None, text_col: str = "text") -> DataFrame:
    """docs with `base_spans` and `spans` (base and method's), arrays of struct(start, end, kind), of each whole text.

    Null counts as empty: no spans. Rows are scanned one by one where they lie; there is no shuffle.
    Repeated rows get equal spans; columns of docs with the new names give way; empty input gives an empty result.
    """
    modest_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model or SecretModel(*labelled_credentials()))
    one = "array<struct<start:int,end:int,kind:string>>"

    @pandas_udf(f"struct<base:{one},every:{one}>")
    def scan(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            base = base_spans(t or "")
            every = sorted(base + method_spans(t or "", base, shared.value), key=lambda x: (x[0], KINDS.index(x[2])))
            rows.append(tuple([{"start": s, "end": e, "kind": k} for s, e, k in x] for x in (base, every)))
        return pd.DataFrame(rows, columns=["base", "every"])

    names = [c for c in docs.columns if c not in ("base_spans", "spans", "_scan")]
    found = docs.select(*names, scan(F.col(text_col)).alias("_scan"))
    return found.select(*names, F.col("_scan.base").alias("base_spans"), F.col("_scan.every").alias("spans"))


def joined(spans: str):
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op3_secret_scan(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan_secrets(docs)
    count = lambda kind: F.size(F.filter("base_spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(joined("base_spans").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"),
    )
