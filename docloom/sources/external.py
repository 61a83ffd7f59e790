"""Readers that call a program of the machine: OCR of images and PDFs, conversion of PDFs.

Sources are never changed: a program gets a copy in a folder of its own, which ends with
the call. A program that is missing, fails or takes too long is an error of the file.
"""

from __future__ import annotations

import os
import shutil
import subprocess
import tempfile
from collections.abc import Callable
from pathlib import Path

TAIL = 2000  # characters of a program's complaint that an error keeps (O6)
LANGUAGES = "deu+eng"


def available(program: str) -> bool:
    """Whether a program is on the path: asked once before a run, not once a file."""
    return shutil.which(program) is not None


def complaint(error: Exception) -> str:
    """What a program said when it failed, its end only."""
    if isinstance(error, FileNotFoundError):
        return f"not installed: {error.filename}"
    if isinstance(error, subprocess.TimeoutExpired):
        return f"no answer in {error.timeout:.0f} s"
    said = [x.decode("utf-8", "replace") if isinstance(x, bytes) else x or "" for x in (getattr(error, "stderr", ""), getattr(error, "stdout", ""))]
    return f"exit {getattr(error, 'returncode', '?')}: {next((s.strip()[-TAIL:] for s in said if s.strip()), 'no output')}"


def program_reader(command: list[str], seconds: int, suffix: str, produced: str | None = None) -> Callable[[bytes], str]:
    """A reader that runs a command on a copy of the file.

    In the command, {file} and {folder} stand for the copy and its folder. Without
    `produced` the text is what the program writes to its output; else it is the first file,
    by name, that matches this pattern below the folder.
    """

    def read(content: bytes) -> str:
        with tempfile.TemporaryDirectory() as folder:
            path = os.path.join(folder, f"source{suffix}")
            Path(path).write_bytes(content)
            try:
                done = subprocess.run([part.format(file=path, folder=folder) for part in command], capture_output=True, check=True, timeout=seconds)
            except (OSError, subprocess.SubprocessError) as e:
                raise RuntimeError(complaint(e)) from e
            if produced is None:
                return done.stdout.decode("utf-8", "replace")
            found = sorted(Path(folder).rglob(produced))
            if not found:
                raise RuntimeError("no output")
            return found[0].read_text("utf-8")

    return read


def image_readers(languages: str = LANGUAGES) -> dict[str, Callable[[bytes], str]]:
    """OCR of images by tesseract."""
    return {s: program_reader(["tesseract", "{file}", "stdout", "-l", languages], 300, s) for s in (".png", ".jpg", ".jpeg")}


def layout_reader() -> Callable[[bytes], str]:
    """A PDF as markdown by marker_single."""
    return program_reader(["marker_single", "{file}", "--output_dir", "{folder}", "--output_format", "markdown"], 600, ".pdf", "*.md")


def with_ocr(text_layer: Callable[[bytes], str], languages: str = LANGUAGES) -> Callable[[bytes], str]:
    """The text layer of a PDF, or of a copy that ocrmypdf has given one."""
    recognised = program_reader(["ocrmypdf", "-l", languages, "--skip-text", "--sidecar", "{folder}/text.txt", "{file}", "{folder}/out.pdf"], 600, ".pdf", "text.txt")

    def read(content: bytes) -> str:
        text = text_layer(content)
        return text if text.strip() else recognised(content)

    return read


def described_images(describe: Callable[[str], str], readers: dict[str, Callable[[bytes], str]] | None = None) -> dict[str, Callable[[bytes], str]]:
    """Readers of images that put what a model sees in front of what OCR reads (L6). describe: data URL -> text."""
    import base64

    from docloom.operators.extraction import IMAGE_TYPES

    readers = readers if readers is not None else image_readers()

    def one(suffix: str, read: Callable[[bytes], str]) -> Callable[[bytes], str]:
        return lambda content: "\n\n".join(t for t in (describe(f"data:{IMAGE_TYPES.get(suffix, 'image/png')};base64,{base64.b64encode(content).decode()}"), read(content)) if t.strip())

    return {s: one(s, r) for s, r in readers.items()}
