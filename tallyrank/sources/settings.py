"""Settings kept as lines of KEY=value."""

from __future__ import annotations

#: Fixed value: the key whose value stands without quotes.
BARE = ("LOCAL_OCR_BACKEND",)


def read_settings(lines: list[str]) -> dict[str, str]:
    """Keys and values of the lines that are no comment; of a key that stands there twice the last."""
    cut = (x.strip().split("=", 1) for x in lines if "=" in x and not x.strip().startswith("#"))
    return {k.strip(): v.strip().strip('"').strip("'") for k, v in cut}


def upsert_settings(lines: list[str], changes: dict[str, str | None]) -> list[str]:
    """The lines with the changes made in place, new keys at the end. Null, and values with an asterisk (a masked value
    that came back), change nothing; a line break in a value is an error."""
    out = list(lines)
    at = {x.strip().split("=", 1)[0].strip(): i for i, x in enumerate(lines) if "=" in x and not x.strip().startswith("#")}
    for key, value in changes.items():
        if value is None or "*" in value:
            continue
        if "\n" in value or "\r" in value:
            raise ValueError(f"the value of {key} has a line break")
        value = value.strip().strip('"').strip("'")
        line = f"{key}={value}\n" if key in BARE else f'{key}="{value}"\n'
        if key in at:
            out[at[key]] = line
        else:
            at[key] = len(out)
            out.append(line)
    return out
