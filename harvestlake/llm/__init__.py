"""Training-data operators: mixing, archives, page text, token counts, rules, chats, repeats, toxicity, leaks and joins."""
