"""Patterns that several functions share."""

#: Fixed value: a link with its target in double, single or no quotes, and its text.
ANCHOR = r"""(?is)<a\b[^>]*?\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))[^>]*>(.*?)</a\s*>"""
