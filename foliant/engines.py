"""What a deployment plugs in: a page renderer and an OCR engine, created once per partition."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import partial
from typing import Protocol


class OcrEngine(Protocol):
    def read(self, image: bytes, lang: str) -> str:
        """The text of an image."""


class PageRenderer(Protocol):
    def render(self, content: bytes, pages: list[int], dpi: int) -> Iterable[bytes]:
        """Images of the 0-based pages, in order; fewer if the file has fewer.

        A renderer that has render_path(path, pages, dpi) is given the file's path instead and reads what it needs.
        """


class StubEngine:
    """Reads an image as UTF-8 text; an image of b"!" fails.  For tests and dry runs."""

    def read(self, image: bytes, lang: str) -> str:
        if image == b"!":
            raise RuntimeError("stub failure")
        return image.decode("utf-8", "replace").strip()


class StubRenderer:
    """Takes the lines of the content as its pages."""

    def render(self, content: bytes, pages: list[int], dpi: int) -> Iterable[bytes]:
        lines = content.split(b"\n")
        return [lines[p] for p in pages if p < len(lines)]


class FirstWorking:
    """Tries engines in order and keeps to the first that does not fail on an image."""

    def __init__(self, *makers: Callable[[], OcrEngine]):
        self.engines = [m() for m in makers]

    def read(self, image: bytes, lang: str) -> str:
        error: Exception = RuntimeError("no OCR engine")
        for engine in self.engines:
            try:
                return engine.read(image, lang)
            except Exception as e:  # noqa: BLE001
                error = e
        raise error


def dispatch(backend: str, vision: Callable[[], OcrEngine] | None, tesseract: Callable[[], OcrEngine] | None) -> Callable[[], OcrEngine] | None:
    """The maker of the engine that a back end stands for; auto and vision fall back to the other engine image by image."""
    makers = [m for m in ((tesseract,) if backend == "tesseract" else (vision, tesseract)) if m is not None]
    if len(makers) < 2:
        return makers[0] if makers else None
    return partial(FirstWorking, *makers)


def preflight(engine: Callable[[], OcrEngine] | None, renderer: Callable[[], PageRenderer] | None, lang: str) -> list[str]:
    """What a run with OCR lacks, as warnings: an engine, a renderer, or the language where the engine tells its languages."""
    issues = []
    if renderer is None:
        issues.append("Poppler não encontrado; OCR em PDFs escaneados pode falhar.")
    if engine is None:
        issues.append("Tesseract não encontrado; OCR em imagens e PDFs escaneados pode falhar.")
    elif lang and (languages := getattr(engine(), "languages", None)) is not None:
        missing = [x for x in lang.split("+") if x not in languages()]
        issues += [f"Idioma '{x}' não está instalado no Tesseract." for x in missing]
    return issues
