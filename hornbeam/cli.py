"""Command line: run, explain, diff, check, and an interactive session."""

from __future__ import annotations

import argparse
import json
import os
import sys
from collections.abc import Callable

from . import __version__
from .engine import Engine, QueryResult, Relation
from .errors import DeductiveError
from .operators.maintenance import Delta
from .plans.terms import Query, format_value

HELP = """\
Commands
  :help              this text
  :quit  :q  :exit   leave
  :load FILE         add the rules of a file
  :list              all rules
  :preds             predicates and their sizes
  :show PRED[/N]     all tuples of a relation
  :why FACT          why a ground fact holds
  :retract FACT      take back an asserted fact; show what changes
  :strata            the strata of the predicates
  :stats             figures of the last evaluation
  :reset             forget everything

Clauses end with '.', queries begin with '?-'; an entry may span lines."""


def warn(*words: object) -> None:
    print(*words, file=sys.stderr)


def read(path: str) -> tuple[str, str]:
    if path == "-":
        return sys.stdin.read(), "<stdin>"
    with open(path, encoding="utf-8") as f:
        return f.read(), path


def loaded(files: list[str], **how) -> tuple[Engine, list[Query]]:
    engine, queries = Engine(**how), []
    for path in files:
        queries += engine.load(*read(path))
    return engine, queries


def table(result: QueryResult, indent: str = "  ") -> str:
    """Answers in aligned columns."""
    if result.is_ground:
        return indent + ("yes." if result.rows else "no.")
    if not result.rows:
        return indent + "no answers."
    lines = [[format_value(v) for v in row] for row in result.rows]
    widths = [max(map(len, column)) for column in zip(result.variables, *lines)]
    lines = [list(result.variables), ["-" * w for w in widths], *lines]
    out = [(indent + "  ".join(c.ljust(w) for c, w in zip(line, widths))).rstrip() for line in lines]
    return "\n".join([*out, f"{indent}{len(result)} answer{'s' * (len(result) != 1)}."])


def listing(relation: Relation, indent: str = "  ") -> str:
    rows = relation.sorted_tuples()
    facts = [f"{relation.name}({', '.join(map(format_value, row))})." if row else f"{relation.name}." for row in rows]
    return "\n".join(indent + f for f in facts) or f"{indent}(empty)"


def relation_named(engine: Engine, spec: str) -> Relation:
    name, slash, arity = spec.rpartition("/")
    if slash and not arity.isdigit():
        raise DeductiveError(f"bad predicate {spec!r}; write name or name/arity")
    return engine.relation(name, int(arity)) if slash else engine.relation(spec)


def figures(stats: dict, indent: str = "") -> str:
    get = stats.get
    return f"{indent}{get('rules', 0)} rules, {get('predicates', 0)} predicates, {get('tuples', 0)} tuples, {get('strata', 0)} strata, {get('iterations', 0)} iterations in {1000 * get('seconds', 0.0):.1f} ms"


def strata(engine: Engine) -> str:
    return "\n".join(f"stratum {k}: {', '.join(f'{n}/{a}' for n, a in sorted(level))}" for k, level in enumerate(engine.strata))


def bare(fact: str) -> str:
    return fact.strip().rstrip(".")


def dump(payload: dict) -> None:
    print(json.dumps(payload, indent=2))


def run(args: argparse.Namespace) -> int:
    engine, queries = loaded(args.files)
    for text in args.query:
        queries.append(engine._query(text, "<argument>"))
    if not args.demand:
        engine.run()
    if args.warn_undefined:
        for name, arity in engine.undefined_predicates():
            warn(f"warning: {name}/{arity} is used but never defined; it is empty")
    results = [(q, engine.query(q, demand=args.demand)) for q in queries]
    shown = [engine.relation(*s) for s in engine.predicates()] if args.show_all else [relation_named(engine, s) for s in args.show]
    if args.json:
        answers = [{"query": str(q), "variables": r.variables, "rows": [list(row) for row in r.rows], **({"stats": r.stats} if r.stats is not None else {})} for q, r in results]
        dump({"queries": answers, "relations": {f"{r.name}/{r.arity}": [list(t) for t in r.sorted_tuples()] for r in shown}, "stats": engine.stats})
    else:
        for r in shown:
            print(f"% {r.name}/{r.arity} ({len(r)} tuples)\n{listing(r)}\n")
        for q, r in results:
            print(f"{q}\n{table(r)}\n")
    if args.strata:
        warn(strata(engine))
    if args.stats and not args.demand:
        warn(figures(engine.stats))
    elif args.stats:
        for q, r in results:
            rewritten = r.stats is not None
            warn(q if rewritten else f"{q}\n  (not rewritten; answered by evaluating the whole program)")
            warn(figures(r.stats if rewritten else engine.stats, "  "))
    return 0


def explain(args: argparse.Namespace) -> int:
    engine, _ = loaded(args.files, track_derivations=True)
    proof = engine.explain(args.fact)
    if proof is None:
        if args.json:
            dump({"fact": args.fact, "derivation": None})
        else:
            warn(f"{bare(args.fact)} is not derivable.")
        return 1
    if args.json:
        dump(proof.to_dict())
    else:
        print("\n".join(f"{a}." for a in proof.support()) if args.facts else proof)
    return 0


def diff(args: argparse.Namespace) -> int:
    engine, _ = loaded(args.files)
    engine.run()
    for fact in args.remove:
        if not engine.is_asserted(fact):
            warn(f"warning: {bare(fact)} is not a fact of this program, so there is nothing to retract")
    delta = engine.update(add=args.add, remove=args.remove)
    added, removed = delta.added_facts(args.only), delta.removed_facts(args.only)
    if args.json:
        dump(delta.to_dict() | {"added": [str(a) for a in added], "removed": [str(a) for a in removed]})
        return 0
    if added or removed:
        print(delta.format(args.only))
    warn(f"{len(added)} added, {len(removed)} removed." if added or removed else "no change.")
    if args.stats:
        get = delta.stats.get
        warn(f"{get('mode', 'incremental')}: {get('tuples', 0)} tuples, {get('iterations', 0)} iterations, {get('rederived', 0)} rederived in {1000 * get('seconds', 0.0):.1f} ms")
    return 0


def check(args: argparse.Namespace) -> int:
    engine, _ = loaded(args.files)
    engine.run()
    for name, arity in engine.undefined_predicates():
        warn(f"warning: {name}/{arity} is used but never defined")
    warn(f"ok: {len(engine.rules)} rules, {len(engine.strata)} strata")
    return 0


class Session:
    """The interactive session: clauses are added, queries answered, commands carried out."""

    def __init__(self, engine: Engine):
        self.engine = engine
        self.commands: dict[str, Callable[[str], bool | None]] = {
            ":help": lambda _: print(HELP), ":h": lambda _: print(HELP), ":?": lambda _: print(HELP),
            ":quit": lambda _: True, ":q": lambda _: True, ":exit": lambda _: True,
            ":load": self.load, ":list": self.list, ":preds": self.preds, ":show": self.show, ":why": self.why,
            ":retract": self.retract, ":strata": self.strata, ":stats": self.stats, ":reset": self.reset,
        }
        self.needs = {":load": "FILE", ":show": "PRED[/ARITY]", ":why": "FACT", ":retract": "FACT"}

    def load(self, path: str) -> None:
        self.enter(*read(path), echo=True)
        print(f"  loaded {path} ({len(self.engine.rules)} rules total)")

    def list(self, _: str) -> None:
        print("\n".join(f"  {rule}" for rule in self.engine.rules) or "  (no rules loaded)")

    def preds(self, _: str) -> None:
        for r in self.engine.relations.values():
            print(f"  {r.name}/{r.arity}  {len(r)} tuples")

    def show(self, spec: str) -> None:
        print(listing(relation_named(self.engine, spec.split()[0])))

    def why(self, fact: str) -> None:
        proof = self.engine.explain(fact)
        lines = [f"{bare(fact)} is not derivable."] if proof is None else str(proof).splitlines()
        print("\n".join(f"  {line}" for line in lines))

    def retract(self, fact: str) -> None:
        if not self.engine.is_asserted(fact):
            print(f"  {bare(fact)} is not a fact of this session.")
            return
        delta: Delta = self.engine.retract_fact(fact)
        print("\n".join(f"  {line}" for line in delta.format().splitlines()) if delta else "  no change.")

    def strata(self, _: str) -> None:
        self.engine.run()
        print(strata(self.engine))

    def stats(self, _: str) -> None:
        self.engine.run()
        print(figures(self.engine.stats))

    def reset(self, _: str) -> None:
        self.engine.reset()
        print("  cleared")

    def command(self, line: str) -> bool:
        """True if the session ends."""
        name, _, argument = line.partition(" ")
        argument = argument.strip()
        if name not in self.commands:
            warn(f"unknown command {name} (try :help)")
        elif name in self.needs and not argument:
            warn(f"usage: {name} {self.needs[name]}")
        else:
            try:
                return bool(self.commands[name](argument))
            except (DeductiveError, OSError) as e:
                warn(f"error: {e}")
        return False

    def enter(self, text: str, source_name: str = "<repl>", echo: bool = False) -> None:
        """One complete entry; what fails is rolled back."""
        before = len(self.engine.rules)
        queries = self.engine.load(text, source_name)
        added = len(self.engine.rules) - before
        try:
            self.engine.run()
            for q in queries:
                if echo:
                    print(q)
                print(table(self.engine.query(q)))
        except DeductiveError:
            self.engine.truncate_rules(before)
            raise
        if added and not queries and not echo:
            print(f"  ok ({added} clause{'s' * (added != 1)})")

    def loop(self) -> int:
        entry = ""
        while True:
            try:
                line = input("   " if entry else "?- ")
            except EOFError:
                print()
                return 0
            except KeyboardInterrupt:
                print("^C")
                entry = ""
                continue
            if not entry and not line.strip():
                continue
            if not entry and line.strip().startswith(":"):
                if self.command(line.strip()):
                    return 0
                continue
            entry = f"{entry}\n{line}" if entry else line
            if entry.rstrip().endswith("."):
                try:
                    self.enter(entry)
                except DeductiveError as e:
                    warn(f"error: {e}")
                entry = ""


def repl(args: argparse.Namespace) -> int:
    session = Session(Engine())
    for path in args.files:
        session.enter(*read(path), echo=True)
    if args.files:
        print(f"loaded {len(session.engine.rules)} rules from {', '.join(args.files)}")
    if sys.stdin.isatty():
        _history()
    print(f"hornbeam {__version__} - :help for commands, :quit to leave")
    return session.loop()


def _history() -> None:
    try:
        import atexit
        import readline
    except ImportError:
        return
    path = os.path.expanduser("~/.hornbeam_history")
    try:
        readline.read_history_file(path)
    except OSError:
        pass
    readline.set_history_length(1000)
    atexit.register(readline.write_history_file, path)


def arguments() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="hornbeam", description="Deductive queries on Spark: recursion, negation, aggregates, demand, changes and proofs.")
    out.add_argument("--version", action="version", version=f"hornbeam {__version__}")
    parts = out.add_subparsers(dest="command")

    def part(handler, files: str = "+", **how) -> argparse.ArgumentParser:
        p = parts.add_parser(handler.__name__, **how)
        p.set_defaults(handler=handler)
        if handler is explain:
            p.add_argument("fact", metavar="FACT", help="a ground fact")
        p.add_argument("files", nargs=files, help="program files ('-' for standard input)")
        return p

    p = part(run, help="evaluate a program and answer its queries")
    p.add_argument("-q", "--query", action="append", default=[], metavar="GOAL", help="one more goal")
    p.add_argument("-s", "--show", action="append", default=[], metavar="PRED", help="print a relation")
    for flag, what in (("--show-all", "print every relation"), ("--json", "print JSON"), ("--demand", "derive only what the queries need"), ("--stats", "print figures"), ("--strata", "print the strata"), ("--warn-undefined", "name predicates that nothing defines")):
        p.add_argument(flag, action="store_true", help=what)
    p = part(explain, help="why a fact holds")
    p.add_argument("--facts", action="store_true", help="only the base facts it rests on")
    p.add_argument("--json", action="store_true", help="print JSON")
    p = part(diff, help="what asserting or retracting facts changes")
    p.add_argument("--add", action="append", default=[], metavar="FACT", help="a fact to assert")
    p.add_argument("--remove", action="append", default=[], metavar="FACT", help="a fact to retract")
    p.add_argument("--only", metavar="PRED", help="changes of one predicate")
    p.add_argument("--json", action="store_true", help="print JSON")
    p.add_argument("--stats", action="store_true", help="print figures")
    part(check, help="validate without answering")
    part(repl, "*", help="an interactive session")
    return out


def main(argv: list[str] | None = None) -> int:
    parser = arguments()
    args = parser.parse_args(argv)
    if args.command is None:
        parser.print_help()
        return 2
    try:
        return args.handler(args)
    except BrokenPipeError:
        return 0
    except (DeductiveError, OSError) as e:
        warn(f"error: {e}")
        return 1


if __name__ == "__main__":
    sys.exit(main())
