"""What a caller uses: search the history of a project, read a chunk, see and change the index."""

from __future__ import annotations

import os
import time

from pyspark.sql import DataFrame, SparkSession

from turnstone.plans import search as Q
from turnstone.plans import settings
from turnstone.plans.index import Index, Refresh, index_path
from turnstone.plans.settings import Settings
from turnstone.sources import sessions as S


class History:
    """The history of one project: logs in ``folder``, the index at ``path``."""

    def __init__(self, spark: SparkSession, root: str, folder: str, path: str, settings: Settings | None = None):
        self.project = S.project_of(root)
        self.folder, self.settings = folder, settings or Settings()
        self.index = Index(spark, path, self.project)

    def search_project_history(self, query: str | dict[str, str], max_results: int = Q.DEFAULT_RESULTS, min_relevance: int | None = None, min_confidence: int | None = None, active_id: str | None = None, now_ms: int | None = None) -> DataFrame | None:
        """Ranked chunks for one query or many; the index is brought up to date first. None while the history is off or empty."""
        if not self.settings.enabled:
            return None
        self.index.refresh(self.folder, active_id)
        tables = self.index.tables()
        if tables is None:
            return None
        s = self.settings
        options = Q.Options(
            now_ms=int(time.time() * 1000) if now_ms is None else now_ms,
            max_results=max_results,
            min_relevance=s.min_relevance if min_relevance is None else min_relevance,
            min_confidence=s.min_confidence if min_confidence is None else min_confidence,
            exclude_session=None,
            high_days=s.freshness_high_days,
            medium_days=s.freshness_medium_days,
        )
        return Q.search(tables, {"q": query} if isinstance(query, str) else query, options, self.project.project_id)

    history_search = search_project_history

    def read_project_history(self, chunk_id: str, active_id: str | None = None) -> DataFrame | None:
        """One chunk with all that is known of it, of this project only; the index is brought up to date first. None while the history is off or empty."""
        if not self.settings.enabled:
            return None
        self.index.refresh(self.folder, active_id)
        tables = self.index.tables()
        return None if tables is None else Q.chunk_detail(tables, chunk_id, self.project.project_id)

    def read_as_text(self, chunk_id: str, active_id: str | None = None) -> str:
        if not self.settings.enabled:
            return OFF
        found = self.read_project_history(chunk_id, active_id)
        chunk = found.first() if found is not None else None
        return Q.render_detail(chunk) if chunk else f"No chunk {chunk_id} in this project's history."

    def status(self) -> DataFrame:
        """Settings, the index's place, figures of the last refresh and numbers of rows, as one row."""
        if self.settings.enabled:
            self.index.refresh(self.folder)
        return self.index.status(self.settings)

    def rebuild(self) -> Refresh:
        return self.index.rebuild(self.folder)

    def clear(self) -> list[str]:
        return self.index.clear()


_OPEN: dict[tuple[str, str], History] = {}


def history_of(spark: SparkSession, root: str, folder: str, path: str | None = None, settings: Settings | None = None) -> History:
    """The history of a project, opened once for each project and index."""
    path = path or index_path(root, os.path.expanduser("~"))
    key = (S.project_of(root).project_id, path)
    if key not in _OPEN or _OPEN[key].index.spark is not spark:
        _OPEN[key] = History(spark, root, folder, path, settings)
    return _OPEN[key]


def forget() -> None:
    """Close all histories that are open."""
    _OPEN.clear()


OFF = "The history is off; the command on turns it on."

#: What the command line can do.
COMMANDS = {
    "query": "search this project's history for the words that follow",
    "read": "show one chunk, by its id",
    "settings": "show the settings in effect",
    "status": "show settings, the index's place and its figures",
    "rebuild": "read all sessions anew",
    "clear": "delete the index; sessions stay as they are",
    "on": "turn the history on for this project",
    "off": "turn it off",
    "help": "show this",
}


def help_text() -> str:
    return "\n".join(["Search what was said and done in a project's sessions.", "", *[f"  {name:<9} {what}" for name, what in COMMANDS.items()], "", "Words that are no command are searched for. Without any, the commands are offered."])


def completions(prefix: str) -> list[str]:
    """Commands that begin with what is typed."""
    return [c for c in COMMANDS if c.startswith(prefix.strip().lower())]


def parsed(words: list[str], ask=None) -> tuple[str, list[str]]:
    """The command and its words: the first word where it is one, else a search. Without words ``ask(commands)`` picks one."""
    if not words:
        picked = ask(list(COMMANDS)) if ask else "help"
        return (picked, []) if picked in COMMANDS else ("help", [])
    head, *rest = words
    return (head.lower(), rest) if head.lower() in COMMANDS else ("query", words)


def main(arguments: list[str] | None = None, ask=None) -> int:
    """Command line; see ``help``."""
    import argparse

    parser = argparse.ArgumentParser(prog="turnstone", description=help_text(), formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("words", nargs="*")
    for name in ("root", "logs", "index"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--settings", default=os.path.expanduser("~/.turnstone/settings.json"))
    parser.add_argument("--project-settings", default=None)
    said = parser.parse_args(arguments)
    command, words = parsed(said.words, ask)
    own = said.project_settings or os.path.join(said.root, ".turnstone.json")
    if command == "help":
        print(help_text())
        return 0
    if command in ("on", "off"):
        settings.save(own, {"enabled": command == "on"})
        return 0
    chosen = settings.load(said.settings, own)
    if command == "settings":
        print(chosen)
        return 0
    if not chosen.enabled and command in ("query", "read", "rebuild"):
        print(OFF)
        return 1
    spark = SparkSession.builder.getOrCreate()
    history = History(spark, said.root, said.logs, said.index, chosen)
    if command == "query":
        found = history.search_project_history(" ".join(words))
        print(Q.render(found.collect() if found is not None else []))
    elif command == "read":
        print(history.read_as_text(words[0] if words else ""))
    elif command == "status":
        print("\n".join(f"{k}: {v}" for k, v in history.status().first().asDict().items()))
    elif command == "rebuild":
        print(history.rebuild())
    else:
        print(*history.clear(), sep="\n")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
