"""A tiny linear-history simulator: random commits rendered as a
``git log --patch --reverse`` text, with the true line lifecycle.

Line texts are unique, so difflib's unified diff is exactly the edit made.
Each commit touches a path at most once, as git shows it.
"""

from __future__ import annotations

import datetime as dt
import difflib
import random

T0 = dt.datetime(2018, 9, 10, 9, 0, 0)


class File:
    def __init__(self, path, added):
        self.path = path
        self.added = added
        self.removed = None
        self.lines: list[dict] = []


class Sim:
    def __init__(self, seed: int, authors=("ann", "bob", "cat", "dan")):
        self.rng = random.Random(seed)
        self.authors = authors
        self.live: dict[str, File] = {}
        self.all_files: list[File] = []
        self.all_lines: list[dict] = []
        self.t = T0
        self.commits: list[str] = []
        self.n = 0
        self.last_change = None

    def _line(self, f, author):
        self.n += 1
        rec = {"text": f"line {self.n} by {author}", "file": f, "creator": author, "created": self.t,
               "remover": None, "removed": None}
        self.all_lines.append(rec)
        return rec

    def _close(self, rec, author):
        rec["remover"], rec["removed"] = author, self.t

    @staticmethod
    def _hunks(old, new, n=3):
        return list(difflib.unified_diff(old, new, lineterm="", n=n))[2:]

    def _changed(self):
        self.last_change = self.t if self.last_change is None else max(self.last_change, self.t)

    def _path(self, ext=None):
        self.n += 1
        ext = ext or self.rng.choice([".java", ".py"])
        return f"src/f{self.n}{ext}"

    def create(self, author, path=None):
        path = path or self._path()
        f = File(path, self.t)
        f.lines = [self._line(f, author) for _ in range(self.rng.randint(0, 6))]
        self.live[path] = f
        self.all_files.append(f)
        self._changed()
        d = [f"diff --git a/{path} b/{path}", "new file mode 100644", "index 0000000..1111111"]
        if f.lines:
            d += ["--- /dev/null", f"+++ b/{path}"] + self._hunks([], [x["text"] for x in f.lines])
        return d

    def edit(self, author, path, new_path=None):
        f = self.live.pop(path)
        old = list(f.lines)
        new = []
        for rec in old:
            r = self.rng.random()
            if r < 0.25:
                self._close(rec, author)
                continue
            if r < 0.4:
                new += [self._line(f, author) for _ in range(self.rng.randint(1, 2))]
            new.append(rec)
        if self.rng.random() < 0.5 or not new:
            pos = self.rng.randint(0, len(new))
            new[pos:pos] = [self._line(f, author) for _ in range(self.rng.randint(1, 3))]
        f.lines = new
        f.path = new_path or path
        self.live[f.path] = f
        self._changed()
        hunks = self._hunks([x["text"] for x in old], [x["text"] for x in new], n=self.rng.choice([0, 1, 3]))
        if new_path:
            head = [f"diff --git a/{path} b/{new_path}", "similarity index 80%", f"rename from {path}",
                    f"rename to {new_path}", "index 1111111..2222222 100644", f"--- a/{path}", f"+++ b/{new_path}"]
        else:
            head = [f"diff --git a/{path} b/{path}", "index 1111111..2222222 100644", f"--- a/{path}", f"+++ b/{path}"]
        return head + hunks

    def rename(self, path, new_path):
        f = self.live.pop(path)
        f.path = new_path
        self.live[new_path] = f
        return [f"diff --git a/{path} b/{new_path}", "similarity index 100%", f"rename from {path}", f"rename to {new_path}"]

    def delete(self, author, path, binary=False):
        f = self.live.pop(path)
        for rec in f.lines:
            self._close(rec, author)
        f.removed = self.t
        self._changed()
        d = [f"diff --git a/{path} b/{path}", "deleted file mode 100644", "index 1111111..0000000"]
        if binary:
            return d + [f"Binary files a/{path} and /dev/null differ"]
        if f.lines:
            d += [f"--- a/{path}", "+++ /dev/null"] + self._hunks([x["text"] for x in f.lines], [])
        return d

    def run(self, n_commits: int):
        freed: list[str] = []  # deleted paths, for re-creates
        for _ in range(n_commits):
            self.t += dt.timedelta(minutes=self.rng.randint(1, 60 * 40), seconds=self.rng.randint(0, 59))
            author = self.rng.choice(self.authors)
            touched: set[str] = set()
            diffs = []
            for _ in range(self.rng.randint(0, 3)):
                free = sorted(p for p in self.live if p not in touched)
                r = self.rng.random()
                if not free or r < 0.2:
                    reuse = [p for p in freed if p not in self.live and p not in touched]
                    path = self.rng.choice(reuse) if reuse and self.rng.random() < 0.5 else None
                    diffs.append(self.create(author, path))
                    touched.add(next(reversed(self.live)))
                    continue
                p = self.rng.choice(free)
                if r < 0.65:
                    diffs.append(self.edit(author, p))
                    touched.add(p)
                elif r < 0.77:
                    q = self._path(p[p.rfind("."):]).replace("src/", "moved/")
                    diffs.append(self.edit(author, p, new_path=q))
                    touched.update((p, q))
                elif r < 0.87:
                    q = self._path(p[p.rfind("."):]).replace("src/", "moved/")
                    diffs.append(self.rename(p, q))
                    touched.update((p, q))
                else:
                    diffs.append(self.delete(author, p, binary=self.rng.random() < 0.2))
                    touched.add(p)
                    freed.append(p)
            head = [f"commit {self.rng.getrandbits(160):040x}", f"Author: {author.title()} <{author}@example.org>",
                    f"Date:   {self.t.strftime('%a %b %-d %H:%M:%S %Y')} +0200", "", f"    change {len(self.commits)}", ""]
            self.commits.append("\n".join(head + [x for d in diffs for x in d]) + "\n")
        return self

    def log_text(self) -> str:
        return "\n".join(self.commits)

    def truth(self, include_removed_files=False):
        """(path, creator, remover, created, removed, lifespan) per line."""
        last_day = self.last_change + dt.timedelta(days=1)
        out = []
        for rec in self.all_lines:
            f = rec["file"]
            if f.removed is not None and not include_removed_files:
                continue
            end = rec["removed"] or last_day
            out.append((f.path, rec["creator"], rec["remover"], rec["created"], rec["removed"],
                        max((end - rec["created"]).days, -1)))
        return out

    def files_truth(self):
        return sorted((f.path, f.added, f.removed) for f in self.all_files)
