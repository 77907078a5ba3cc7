"""Small SQL text builders shared by the DuckDB statements."""


def r6(expr: str, name: str) -> str:
    return f"round({expr}, 6) + 0.0 AS {name}"


def clip(x, lo, hi):
    return f"least(greatest({x}, {lo}), {hi})"


CAMERA = """ext[1]*x+ext[2]*y+ext[3]*z+ext[4] AS cx, ext[5]*x+ext[6]*y+ext[7]*z+ext[8] AS cy, ext[9]*x+ext[10]*y+ext[11]*z+ext[12] AS cz"""


def camera(x="x", y="y", z="z", out=""):
    return ", ".join(f"ext[{4*i+1}]*{x}+ext[{4*i+2}]*{y}+ext[{4*i+3}]*{z}+ext[{4*i+4}] AS c{n}{out}"
                     for i, n in enumerate("xyz"))


def pixel(out=""):
    """u, v from cx, cy, cz and k (call one SELECT above ``camera``)."""
    c = f"cx{out}", f"cy{out}", f"cz{out}"
    den = f"nullif(k[7]*{c[0]}+k[8]*{c[1]}+k[9]*{c[2]}, 0)"
    return (f"(k[1]*{c[0]}+k[2]*{c[1]}+k[3]*{c[2]})/{den} AS u{out}, "
            f"(k[4]*{c[0]}+k[5]*{c[1]}+k[6]*{c[2]})/{den} AS v{out}")


def linear(c):
    return f"CASE WHEN {c}/255.0::DOUBLE <= 0.04045 THEN {c}/255.0::DOUBLE/12.92 ELSE pow(({c}/255.0::DOUBLE+0.055)/1.055, 2.4) END"


def encode(c):
    g = f"greatest({c}, 0.0)"
    return f"(CASE WHEN {g} <= 0.0031308 THEN {g}*12.92 ELSE pow({g}, 1/2.4::DOUBLE)*1.055-0.055 END)*255.0"
