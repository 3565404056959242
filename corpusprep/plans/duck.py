"""DuckDB spellings of the cleaning rules, for the checking SQL."""

HEX_TAG = "<0x([0-9A-Fa-f]{2})>"
HEX_SPLIT = "<0x[0-9A-Fa-f]{2}>"
SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def diag(x: str) -> str:
    return rf"regexp_replace({x}, '(?i)(?:CR13|LF10|CR|LF)([^\p{{L}}\p{{N}}_]|$)', '\1', 'g')"


def fences(x: str) -> str:
    return rf"regexp_replace({x}, '(?m)^```[^\n]*', '', 'g')"


def controls(x: str) -> str:
    return (
        rf"regexp_replace({x}, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F\x{{FDD0}}-\x{{FDEF}}"
        rf"\x{{FFFE}}\x{{FFFF}}]', '', 'g')"
    )


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def unhex(x: str) -> str:
    """Decode tags; `x` must be a plain column or a short expression."""
    return (
        f"list_reduce(list_prepend('', list_transform(list_zip(string_split_regex({x}, '{HEX_SPLIT}'), "
        f"regexp_extract_all({x}, '{HEX_TAG}', 1)), lambda z: z[1] || "
        "coalesce(chr(cast('0x' || z[2] AS integer)), ''))), lambda a, b: a || b)"
    )


def clean(x: str) -> str:
    return controls(fences(diag(unhex(x))))


def render(user: str, assistant: str, begin: str = "<|begin_of_text|>") -> str:
    def turn(role: str, text: str) -> str:
        body = controls(fences(strip(text)))
        return (
            f"'<|start_header_id|>{role}<|end_header_id|>' || chr(10) || chr(10) || {body} || '<|eot_id|>'"
        )

    return f"'{begin}' || {turn('user', user)} || {turn('assistant', assistant)}"


def byte_list(x: str) -> str:
    """Byte ids of a text with chat markers kept whole, between begin and end."""
    marks = ["<|begin_of_text|>", "<|end_of_text|>", "<|start_header_id|>", "<|end_header_id|>", "<|eot_id|>"]
    hexed = [m.encode().hex().upper() for m in marks]
    cases = " ".join(f"WHEN h = '{m}' THEN {3 + i}" for i, m in enumerate(hexed))
    return (
        f"list_concat([1], list_transform(regexp_extract_all(hex(encode({x})), '{'|'.join(hexed)}|..'), "
        f"lambda h: CASE {cases} ELSE cast('0x' || h AS integer) + 8 END), [2])"
    )
