"""A synthetic corpus of C files, made from the rows of a table: each row picks a template by its key.

`CASES` has for every rule some templates and the hits that must be found in them, so that what a query must give
follows from the table alone. `@K` stands for the row's key, `@N` for its size (a number from 1).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: rule -> [(source, [(line, parameters)])]
CASES: dict[int, list[tuple[str, list[tuple[int, tuple[str, ...]]]]]] = {
    1: [
        ("void read_@K(void) {\n  char line[@N];\n  gets(line);\n}\n", [(3, ("call", "gets"))]),
        ("#define ROOM 64\nvoid copy_@K(const char *s) {\n  char to[ROOM];\n  strcpy(to, \"abc\");\n  strcpy(to, s);\n}\n", [(4, ("bounded", "strcpy", "3", "to", "64")), (5, ("call", "strcpy"))]),
        ("char *strcat(char *to, const char *from);\n/* gets(x) */\nvoid say_@K(void) {\n  puts(\"sprintf(a, b)\");\n  scanf(\"%9s\", 0);\n}\n", []),
        ("void scan_@K(char *w) {\n  if (@N) {\n    scanf(\"%s\", w);\n  } else {\n    sprintf(w, \"%d\", @K);\n  }\n}\n", [(3, ("call", "scanf")), (5, ("call", "sprintf"))]),
    ],
    2: [
        ("void log_@K(char *text) {\n  printf(text);\n}\n", [(2, ("printf", "text"))]),
        ("void log_@K(char *text) {\n  printf(\"%s\", text);\n  printf(\"done @N\");\n}\n", []),
        ("void log_@K(char *text) {\n  for (int i = 0; i < @N; i++) {\n    fprintf(stderr, text);\n  }\n}\n", [(3, ("fprintf", "text"))]),
    ],
    3: [
        ("int make_@K(int n) {\n  char *p@K = malloc(@N);\n  p@K[0] = 1;\n  free(p@K);\n  return n;\n}\n", [(2, ("p@K",))]),
        ("int make_@K(int n) {\n  char *p@K = malloc(@N);\n  if (!p@K) {\n    return -1;\n  }\n  p@K[0] = 1;\n  free(p@K);\n  return n;\n}\n", []),
        ("int make_@K(int n) {\n  char *p@K = malloc(@N);\n  if (n > 3) {\n    if (p@K == NULL) {\n      return -1;\n    }\n  }\n  p@K[0] = 1;\n  free(p@K);\n  return n;\n}\n", [(2, ("p@K",))]),
        ("int make_@K(int n) {\n  int *p@K = calloc(n, 4);\n  assert(p@K);\n  *p@K = n;\n  free(p@K);\n  return 0;\n}\n", []),
    ],
    4: [
        ("int get_@K(int *p) {\n  return *p + @N;\n}\n", [(2, ("parameter", "p", "get_@K"))]),
        ("int get_@K(int *p) {\n  if (p == NULL) {\n    return 0;\n  }\n  return *p + @N;\n}\n", []),
        ("int get_@K(int n) {\n  int *q = NULL;\n  if (n > @N) {\n    q = &n;\n  }\n  else {\n    return *q;\n  }\n  return 1;\n}\n", [(7, ("null", "q"))]),
        ("struct s { int v; };\nint get_@K(struct s *a, struct s *b) {\n  if (a && b) {\n    return a->v;\n  }\n  return b->v;\n}\n", [(6, ("parameter", "b", "get_@K"))]),
    ],
    5: [
        ("int same_@K(const char *token_@K, const char *b) {\n  return memcmp(token_@K, b, @N) == 0;\n}\n", [(2, ("memcmp", "token_@K, b, @N"))]),
        ("int same_@K(const char *a, const char *b) {\n  return strcmp(a, b) == 0;\n}\n", []),
        ("int verify_token_@K(const char *a, const char *b) {\n  return strncmp(a, b, @N) == 0;\n}\n", [(2, ("strncmp", "a, b, @N"))]),
    ],
    6: [
        ("void *grow_@K(size_t count) {\n  return malloc(count * @N);\n}\n", [(2, ("allocation", "count", "*", "@N"))]),
        ("void *grow_@K(size_t count) {\n  if (count > SIZE_MAX / @N) {\n    return 0;\n  }\n  return malloc(count * @N);\n}\n", []),
        ("int last_@K(void) {\n  int top_@K = INT_MAX;\n  return top_@K + @N;\n}\n", [(3, ("largest", "top_@K", "+", "@N"))]),
    ],
    7: [
        ("int at_@K(int i) {\n  int table[40];\n  return table[i];\n}\n", [(3, ("variable", "i", "table"))]),
        ("int at_@K(int i) {\n  int table[40];\n  if (i >= 0 && i < 40) {\n    return table[i];\n  }\n  return 0;\n}\n", []),
        ("int at_@K(void) {\n  int table[40];\n  table[39] = @K;\n  table[40] = @N;\n  return 0;\n}\n", [(4, ("constant", "40", "table", "40"))]),
        ("int at_@K(unsigned i) {\n  int table[40];\n  if (i < 41) {\n    return table[i];\n  }\n  return 0;\n}\n", [(4, ("variable", "i", "table"))]),
    ],
    8: [
        ("void end_@K(char *session_key) {\n  memset(session_key, 0, @N);\n  return;\n}\n", [(2, ("session_key", "@N"))]),
        ("void end_@K(char *page) {\n  memset(page, 0, @N);\n  return;\n}\n", []),
        ("int end_@K(char *secret) {\n  memset(secret, 0, @N);\n  int a = 1;\n  int b = 2;\n  int c = 3;\n  return use(secret, a + b + c);\n}\n", [(2, ("secret", "@N"))]),
    ],
    9: [
        ("int status_@K(volatile int *dev) {\n  int *plain = (int *) dev;\n  return plain != 0;\n}\n", [(2, ("dev",))]),
        ("int status_@K(volatile int *dev) {\n  volatile int *kept = (volatile int *) dev;\n  return kept != 0;\n}\n", []),
        ("volatile int flag_@K;\nint *take_@K(void) {\n  return (int *) &flag_@K;\n}\n", [(3, ("flag_@K",))]),
    ],
    10: [
        ("void fill_@K(int n) {\n  char room[n];\n  room[0] = @N;\n}\n", [(2, ("room", "n"))]),
        ("#define N@K @N\nvoid fill_@K(void) {\n  char room[N@K];\n  room[0] = 1;\n}\n", []),
        ("void fill_@K(int n) {\n  while (n > @N) {\n    int part[n + 1];\n    part[0] = n--;\n  }\n}\n", [(3, ("part", "n + 1"))]),
    ],
    11: [
        ("void on_@K(void) { }\nvoid *take_@K(void) {\n  return (void *) on_@K;\n}\n", [(3, ("on_@K",))]),
        ("int x_@K = @N;\nvoid *take_@K(void) {\n  return (void *) &x_@K;\n}\n", []),
        ("long keep_@K(void) {\n  return (long)timer_callback;\n}\n", [(2, ("timer_callback",))]),
    ],
    12: [
        ("int read_@K(const char *s) {\n  return atoi(s) + @N;\n}\n", [(2, ("atoi", "s"))]),
        ("long read_@K(const char *s) {\n  return strtol(s, 0, 10) + @N;\n}\n", []),
        ("double read_@K(const char *s) {\n  if (s) {\n    return atof(s + 1);\n  }\n  return 0; /* atoi(s) */\n}\n", [(3, ("atof", "s + 1"))]),
    ],
    13: [
        ("int step_@K(int n) {\n  if (n > @N)\n    return 1;\n  return 0;\n}\n", [(2, ("if",))]),
        ("int step_@K(int n) {\n  do {\n    n--;\n  } while (n > @N);\n  if (n) {\n    return 1;\n  } else if (n == 2) {\n    return 2;\n  }\n  return 0;\n}\n", []),
        ("int step_@K(int n) {\n  for (int i = 0; i < @N; i++) n += i;\n  while (n > 100)\n    n--;\n  if (n) { n = 1; } else n = 2;\n  return n;\n}\n", [(2, ("for",)), (3, ("while",)), (5, ("else",))]),
        ("int step_@K(int n) {\n#ifdef A\n  if (n > 1\n#else\n  if (n > 2\n#endif\n  ) {\n    n = @N;\n  }\n  return n;\n}\n", None),
    ],
    14: [
        ("char room_@K[512];\n", [(1, ("512",))]),
        ("char room_@K[128];\nchar more_@K[ROOM];\nint few_@K[8];\n", []),
        ("void f_@K(void) {\n  if (@N) {\n    double parts[37];\n    use(parts);\n  }\n}\n", [(3, ("37",))]),
    ],
    15: [
        ("void f_@K(void) { int x = @N; x = x << 3; }\n", [(1, ())]),
        ("void f_@K(void) { unsigned x = @N; x = x << 3; }\n", []),
        ("int f_@K(void) {\n  return -1 << @N;\n}\n", [(2, ())]),
    ],
    16: [
        ("int login_@K(int n) {\n  if (n == @N) {\n    return 1;\n  }\n  return 0;\n}\n", [(1, ("login_@K",))]),
        ("int count_@K(int n) {\n  return 1;\n}\n", []),
        ("int verify_@K(int n) {\n  return n * @N;\n}\n", []),
    ],
    17: [
        ("int pick_@K(int n) {\n  switch (n) {\n    case 1:\n      return @N;\n  }\n  return 0;\n}\n", [(2, ())]),
        ("int pick_@K(int n) {\n  switch (n) {\n    case 1:\n      return @N;\n    default:\n      return 2;\n  }\n}\n", []),
        ("int pick_@K(int n) {\n  switch (n % (2 + 1)) {\n    case 1:\n      switch (n) {\n        default:\n          break;\n      }\n      break;\n  }\n  return @N;\n}\n", [(2, ())]),
    ],
    18: [
        ("int go_@K(int n) {\n  if (n > @N) {\n    goto out_@K;\n  }\n  n = 1;\nout_@K:\n  return n;\n}\n", [(3, ("out_@K",))]),
        ("int go_@K(int n) {\n  /* goto out; */\n  return n + @N;\n}\n", []),
        ("int go_@K(int n) {\nagain:\n  n--;\n  if (n > @N) { goto again; }\n  return n;\n}\n", [(4, ("again",))]),
    ],
    19: [
        ("int now_@K() {\n  return @N;\n}\n", [(1, ("now_@K",))]),
        ("int now_@K(void) {\n  return @N;\n}\n", []),
        ("int later_@K();\nint now_@K(int a) {\n  return later_@K() + a;\n}\nstatic void end_@K()\n{\n}\n", [(5, ("end_@K",))]),
    ],
    20: [
        ("int sum_@K(int a, int b) {\n  return a + @N;\n}\n", [(1, ("b", "sum_@K"))]),
        ("int sum_@K(int a, int unused_b) {\n  return a + @N;\n}\n", []),
        ("int sum_@K(int a,\n          char *ab) {\n  if (@N) {\n    return ab[0];\n  }\n  return 0;\n}\n", [(1, ("a", "sum_@K"))]),
    ],
    21: [
        ("int use_@K(int n) {\n  int *p@K;\n  *p@K = @N;\n  return n;\n}\n", [(2, ("p@K",))]),
        ("int use_@K(int n) {\n  int *p@K;\n  p@K = &n;\n  *p@K = @N;\n  return n;\n}\n", []),
        ("int use_@K(int n) {\n  int *p@K;\n  if (n > @N) {\n    p@K = &n;\n  }\n  return *p@K;\n}\n", [(2, ("p@K",))]),
        ("int use_@K(int n) {\n  int *p@K;\n  switch (n) {\n    case 1:\n      p@K = &n;\n      break;\n    default:\n      return @N;\n  }\n  return *p@K;\n}\n", []),
    ],
    22: [
        ("int drop_@K(char *p) {\n  free(p);\n  p[0] = @N;\n  return 0;\n}\n", [(3, ("p", "2"))]),
        ("int drop_@K(char *p) {\n  free(p);\n  p = NULL;\n  return @N;\n}\n", []),
        ("int drop_@K(char *p, int n) {\n  switch (n) {\n    case 1:\n      free(p);\n    case 2:\n      p[0] = @N;\n      break;\n    default:\n      break;\n  }\n  return 0;\n}\n", [(6, ("p", "4"))]),
        ("int drop_@K(char *p, int n) {\n  if (n) {\n    free(p);\n  } else {\n    p[0] = @N;\n  }\n  return 0;\n}\n", []),
    ],
    23: [
        ("int read_@K(int n) {\n  int x@K;\n  return x@K + @N;\n}\n", [(2, ("x@K",))]),
        ("int read_@K(int n) {\n  int x@K;\n  x@K = n;\n  return x@K + @N;\n}\n", []),
        ("int read_@K(int n) {\n  int x@K;\n  while (n > @N) {\n    x@K = n;\n    n--;\n  }\n  return x@K;\n}\n", [(2, ("x@K",))]),
        ("int read_@K(int n) {\n  int x@K;\n  if (n) {\n    x@K = 1;\n  } else {\n    x@K = 2;\n  }\n  return x@K;\n}\n", []),
    ],
    24: [
        ("char *password_@K = \"pw@K\";\n", [(1, ("password_@K",))]),
        ("char *password_@K = \"\";\nchar *word_@K = \"pw\";\n", []),
        ("void f_@K(void) {\n  const char API_KEY_@K[] = \"k@N\";\n}\n", [(2, ("API_KEY_@K",))]),
    ],
    25: [
        ("int long_@K(int n) {\n" + "  n += @N;\n" * 17 + "  return n;\n}\n", [(1, ("long_@K", "18"))]),
        ("int long_@K(int n) {\n  assert(n);\n" + "  n += @N;\n" * 17 + "  return n;\n}\n", []),
        ("int short_@K(int n) {\n  return n;\n}\n", []),
    ],
    26: [
        ("int put_@K(char *b, int n) {\n  n += snprintf(b + n, @N, \"x\");\n  return n;\n}\n", [(2, ("n",))]),
        ("int put_@K(char *b, int n) {\n  int r = snprintf(b + n, @N, \"x += snprintf(\");\n  return r;\n}\n", []),
        ("int put_@K(char *b) {\n  int at = 0;\n  for (int i = 0; i < @N; i++) {\n    at += snprintf(b + at, 9, \"%d\", i);\n  }\n  return at;\n}\n", [(4, ("at",))]),
    ],
    27: [
        ("int end_@K(char *p) {\n  free(p);\n  free(p);\n  return @N;\n}\n", [(3, ("p",))]),
        ("int end_@K(char *p) {\n  free(p);\n  p = NULL;\n  free(p);\n  return @N;\n}\n", []),
        ("int end_@K(char *p, int n) {\n  if (n > @N) {\n    free(p);\n  }\n  free(p);\n  return 0;\n}\n", [(5, ("p",))]),
        ("int end_@K(char *p, int n) {\n  if (n > @N) {\n    free(p);\n    return 1;\n  }\n  free(p);\n  return 0;\n}\n", []),
    ],
    28: [
        ("int draw_@K(void) {\n  int nonce_@K = rand();\n  return nonce_@K;\n}\n", [(2, ("rand",))]),
        ("int draw_@K(void) {\n  int die = rand();\n  return die % 6;\n}\n", []),
        ("void start_@K(void) {\n  if (@N) {\n    srand(time(NULL));\n  }\n}\n", [(3, ("srand",))]),
    ],
    29: [
        ("void clear_@K(char *p) {\n  memset(p, 0, sizeof(p));\n}\n", [(2, ("p",))]),
        ("void clear_@K(void) {\n  char b[@N];\n  memset(b, 0, sizeof(b));\n}\n", []),
        ("void clear_@K(void) {\n  struct s *q = get();\n  if (q) {\n    memset(q, 0, sizeof q);\n  }\n}\n", [(4, ("q",))]),
    ],
    30: [
        ("int run_@K(const char *cmd) {\n  return system(cmd);\n}\n", [(2, ("system",))]),
        ("int run_@K(void) {\n  return system(\"ls @N\");\n}\n", []),
        ("int run_@K(char **argv) {\n  if (argv) {\n    return execvp(argv[0], argv);\n  }\n  return @N;\n}\n", [(3, ("execvp",))]),
    ],
    31: [
        ("void sum_@K(char *d, char *o) {\n  MD5(d, @N, o);\n}\n", [(2, ("MD5",))]),
        ("void sum_@K(char *d, char *o) {\n  SHA256(d, @N, o);\n  SHA1(d, @N, o);\n}\n", []),
        ("void start_@K(void *ctx, char *k) {\n  if (ctx) {\n    EVP_EncryptInit(ctx, EVP_aes_128_ecb(), k);\n  }\n}\n", [(3, ("EVP_aes_128_ecb",))]),
    ],
    32: [
        ("void *more_@K(char *p) {\n  p = realloc(p, @N);\n  return p;\n}\n", [(2, ("realloc", "p"))]),
        ("void *more_@K(char *p) {\n  char *t = realloc(p, @N);\n  return t;\n}\n", []),
        ("void more_@K(struct b *x) {\n  if (x) {\n    x->data = (char *) realloc(x->data, @N);\n  }\n}\n", [(3, ("realloc", "x->data"))]),
    ],
    33: [
        ("int count_@K(void) {\n  int s = 0;\n  for (unsigned i = @N; i >= 0; i--) {\n    s++;\n  }\n  return s;\n}\n", [(3, ("endless", "i"))]),
        ("int count_@K(int n) {\n  int s = 0;\n  for (int i = n; i >= 0; i--) {\n    s++;\n  }\n  return s;\n}\n", []),
        ("int count_@K(int n, size_t m) {\n  if (n < m) {\n    return @N;\n  }\n  return 0;\n}\n", [(2, ("mixed", "n", "m"))]),
    ],
    34: [
        ("int part_@K(int a, int n) {\n  return a / n + @N;\n}\n", [(2, ("name", "n"))]),
        ("int part_@K(int a, int n) {\n  if (n != 0) {\n    return a / n;\n  }\n  return @N;\n}\n", []),
        ("int part_@K(int a, int n) {\n  if (n == 0) {\n    a = @N;\n  }\n  return a % n;\n}\n", [(5, ("name", "n"))]),
        ("int part_@K(int a, int n) {\n  return a / (n + 1) + a / 0;\n}\n", [(2, ("compound", "n + 1")), (2, ("literal",))]),
    ],
    35: [
        ("int open_@K(const char *path) {\n  if (access(path, 4) == 0) {\n    return open(path, @N);\n  }\n  return -1;\n}\n", [(3, ("access", "2", "path", "open"))]),
        ("int open_@K(const char *path) {\n  if (access(path, 4) == 0) {\n    return @N;\n  } else {\n    return open(path, 0);\n  }\n}\n", []),
        ("int open_@K(char *path, char *other) {\n  struct stat s;\n  stat(path, &s);\n  path = other;\n  return open(path, @N);\n}\n", None),
    ],
    36: [
        ("int keep_@K(int n) {\n  char *p@K = malloc(@N);\n  if (!p@K) {\n    return -1;\n  }\n  if (n) {\n    return 1;\n  }\n  free(p@K);\n  return 0;\n}\n", [(2, ("p@K", "2"))]),
        ("char *keep_@K(int n) {\n  char *p@K = malloc(@N);\n  return p@K;\n}\n", []),
        ("void keep_@K(struct s *out) {\n  char *p@K = strdup(\"a\");\n  char *q = p@K;\n  free(q);\n}\n", []),
        ("void keep_@K(int n) {\n  char *p@K = malloc(@N);\n  use(n);\n}\n", [(2, ("p@K", "2"))]),
    ],
    37: [
        ("void copy_@K(char *d, const char *s) {\n  strncpy(d, s, @N);\n  use(d);\n}\n", [(2, ("strncpy",))]),
        ("void copy_@K(char *d, const char *s) {\n  strncpy(d, s, @N);\n  d[@N] = '\\0';\n}\n", []),
        ("void copy_@K(struct r *r, const char *s) {\n  if (s) {\n    strncpy(r->name, s, @N);\n  }\n}\n", [(3, ("strncpy",))]),
    ],
    38: [
        ("char *name_@K(void) {\n  char b@K[@N];\n  return b@K;\n}\n", [(3, ("b@K", "name_@K"))]),
        ("char *name_@K(void) {\n  static char b@K[@N];\n  return b@K;\n}\n", []),
        ("int *name_@K(int n) {\n  if (n > @N) {\n    return &n;\n  }\n  return 0;\n}\n", [(3, ("n", "name_@K"))]),
    ],
}
# a case without expectation is one whose hits depend on the form that runs; it is left out of queries
CASES = {rule: [(source, hits) for source, hits in cases if hits is not None] for rule, cases in CASES.items()}

ALL_CASES = [(rule, i, source) for rule, cases in sorted(CASES.items()) for i, (source, _) in enumerate(cases)]


def filled(text: str, key: Column, size: Column) -> Column:
    out = F.replace(F.lit(text), F.lit("@K"), key.cast("string"))
    return F.replace(out, F.lit("@N"), size.cast("string"))


def sql_text(text: str) -> str:
    """The same in SQL, of columns p_partkey and p_size."""
    quoted = text.replace("'", "''")
    return f"replace(replace('{quoted}', '@K', CAST(p_partkey AS VARCHAR)), '@N', CAST(p_size AS VARCHAR))"


def corpus(part: DataFrame, sources: list[str]) -> DataFrame:
    """path and content, one file a row: its template is the key's remainder."""
    # narrow rows are dealt out before they become files: analysing a file costs far more than moving its key
    part = part.select("p_partkey", "p_size").repartition(part.sparkSession.sparkContext.defaultParallelism * 2, "p_partkey")
    key, size = F.col("p_partkey"), F.col("p_size")
    which = key % len(sources)
    content = None
    for i, source in enumerate(sources):
        content = F.when(which == i, filled(source, key, size)) if content is None else content.when(which == i, filled(source, key, size))
    return part.select(F.concat(F.lit("src/f"), key.cast("string"), F.lit(".c")).alias("path"), content.alias("content"))


def corpus_sql(sources: list[str]) -> str:
    """The corpus as SQL: path, content, and which template."""
    cases = " ".join(f"WHEN {i} THEN {sql_text(s)}" for i, s in enumerate(sources))
    return f"SELECT 'src/f' || p_partkey || '.c' AS path, CASE p_partkey % {len(sources)} {cases} END AS content, p_partkey % {len(sources)} AS which, p_partkey, p_size FROM part"


def sources_of(rule: int) -> list[str]:
    return [source for source, _ in CASES[rule]]
