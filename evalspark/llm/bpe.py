"""What a byte-pair vocabulary's merges allow, shared by the transducer and the streaming Viterbi encoder.

A sequence of tokens is the encoding of its text exactly when every two
neighbours are the encoding of theirs: merges inside a stretch depend on that
stretch alone until one crosses its border, so the first merge across a border
would also be made in the two tokens beside it.  Hence each prefix of a text
has one last token, found from the last tokens of shorter prefixes.
"""

from __future__ import annotations


class Merges:
    """Tokens as tuples of symbols, in a trie, with the test whether two may stand side by side.

    ``tokens``: id -> tuple of symbols; ``priority(a, b)``: of merging symbols'
    strings a and b (less is earlier), None if they don't merge.
    """

    def __init__(self, tokens: dict[int, tuple], priority, limit: int = 2_000_000):
        self.tokens, self.priority, self.limit = tokens, priority, limit
        self.trie: list[dict] = [{}]  # node -> {symbol: node}
        self.token_at = [-1]          # node -> token that ends here
        self.pairs: dict = {}
        for t, symbols in tokens.items():
            node = 0
            for s in symbols:
                nxt = self.trie[node].get(s)
                if nxt is None:
                    nxt = self.trie[node][s] = len(self.token_at)
                    self.token_at.append(-1)
                    self.trie.append({})
                node = nxt
            self.token_at[node] = t

    def merged(self, symbols, border: int = 0) -> list | None:
        """The strings that the merges leave, the best pair first, the leftmost of equals; None once one crosses ``border``."""
        parts = list(symbols)
        none, priority = float("inf"), self.priority
        rank = [none if (p := priority(a, b)) is None else p for a, b in zip(parts, parts[1:])]
        while rank and (best := min(rank)) != none:
            i = rank.index(best)
            if i == border - 1:
                return None
            border -= i < border
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            del rank[i]
            for j in (i - 1, i):
                if 0 <= j < len(rank):
                    rank[j] = none if (p := priority(parts[j], parts[j + 1])) is None else p
        return parts

    def allowed(self, before: int, token: int) -> bool:
        """Whether ``token`` may follow the token ``before`` (-1: the start; -2: a symbol that no token holds)."""
        key = before << 32 | token
        got = self.pairs.get(key)
        if got is None:
            if len(self.pairs) > self.limit:
                self.pairs.clear()
            left = self.tokens[before] if before >= 0 else ()
            got = self.pairs[key] = len(self.merged((*left, *self.tokens[token]), len(left)) or ()) == (2 if left else 1)
        return got
