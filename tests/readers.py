"""A reader for the command line's test."""

from __future__ import annotations


def shout(system: str, prompt: str) -> str:
    return "loud".upper() if system and prompt else ""
