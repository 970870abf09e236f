"""Texts that break careless operators: empty, blank, one word, no breaks, other scripts, control strings, repeats."""

ODD_TEXTS = [None, "", " ", "\n\t ", "a", "a b c d", "one two three four five", "x" * 5000, "a" * 300 + " " + "é" * 300,
             "日本語のテキスト 😀😀 क्षि", "İstanbul ΣΑΣ ﬁ Ⅷ ½ Ǆ", "é ́x a b c\x1cd\x85e", "</s>[INST] <|im_end|> <|endoftext|>",
             "0 " * 200, "9" * 400, "the same line\n" * 50, "\x00\x01nul", "'s 're 'LL don't", "ab" * 700 + "."]
