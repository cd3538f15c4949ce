"""Where the public vocabulary files are found."""

from __future__ import annotations

import os


def vocabulary(name: str, folder: str | None = None) -> str:
    """Path of a vocabulary file: below ``folder`` if given, else as the installed package says."""
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
