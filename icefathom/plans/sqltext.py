"""SQL text of the formulas, written for the oracle independently of the library."""

from __future__ import annotations

R = "6371.0088e0"
A = "6378137.0e0"
E = "0.0818191908426215e0"


def fx(expr: str, digits: int = 3) -> str:
    unit = f"1e{digits}"
    return f"(floor(({expr}) * {unit} + 0.5e0) / {unit})"


def hav(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    half = (
        f"power(sin(radians(({lat2}) - ({lat1})) / 2), 2)"
        f" + cos(radians({lat1})) * cos(radians({lat2})) * power(sin(radians(({lon2}) - ({lon1})) / 2), 2)"
    )
    # Not asin(least(1, ...)): least skips nulls, and a missing end must give null.
    return f"(2 * {R} * atan2(sqrt({half}), sqrt(abs(1 - ({half})))))"


def _t(phi: str) -> str:
    return f"(tan(pi() / 4 + ({phi}) / 2) / power((1 + {E} * sin({phi})) / (1 - {E} * sin({phi})), {E} / 2))"


_P71 = "radians(-71.0e0)"
M71 = f"(cos({_P71}) / sqrt(1 - {E} * {E} * sin({_P71}) * sin({_P71})))"


def rho(lat: str) -> str:
    return f"({A} * {M71} * {_t(f'radians({lat})')} / {_t(_P71)})"


def px(lat: str, lon: str) -> str:
    return f"({rho(lat)} * sin(radians({lon})))"


def py(lat: str, lon: str) -> str:
    return f"({rho(lat)} * cos(radians({lon})))"


def scale(lat: str) -> str:
    p = f"radians({lat})"
    return f"({rho(lat)} / ({A} * cos({p}) / sqrt(1 - {E} * {E} * sin({p}) * sin({p}))))"


def inverse_lat(x: str, y: str) -> str:
    """Fixed-point iteration, unrolled; the library uses a series instead."""
    t = f"(sqrt(({x}) * ({x}) + ({y}) * ({y})) * {_t(_P71)} / ({A} * {M71}))"
    return t


def inverse_columns(source: str, x: str, y: str, keep: str) -> str:
    """Sub-select that adds ilat, ilon to ``source`` by six unrolled steps."""
    sql = f"select {keep}, {inverse_lat(x, y)} as t_, degrees(atan2({x}, {y})) as ilon from {source}"
    sql = f"select *, pi() / 2 - 2 * atan(t_) as f_ from ({sql}) s_"
    for _ in range(6):
        step = f"pi() / 2 - 2 * atan(t_ * power((1 - {E} * sin(f_)) / (1 + {E} * sin(f_)), {E} / 2))"
        sql = f"select * exclude (f_), {step} as f_ from ({sql}) s_"
    return f"(select * exclude (t_, f_), -degrees(f_) as ilat from ({sql}) s_)"


def bearing(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    y = f"sin(radians(({lon2}) - ({lon1}))) * cos(radians({lat2}))"
    x = (
        f"cos(radians({lat1})) * sin(radians({lat2}))"
        f" - sin(radians({lat1})) * cos(radians({lat2})) * cos(radians(({lon2}) - ({lon1})))"
    )
    return f"((degrees(atan2({y}, {x})) + 360.0e0) - 360.0e0 * floor((degrees(atan2({y}, {x})) + 360.0e0) / 360.0e0))"


def wrap(lon: str) -> str:
    return f"(({lon}) - 360.0e0 * floor((({lon}) + 180.0e0) / 360.0e0))"


def moved_lat(lat: str, brg: str, km: str) -> str:
    d = f"(({km}) / {R})"
    return (
        f"degrees(asin(greatest(-1.0e0, least(1.0e0, sin(radians({lat})) * cos{d}"
        f" + cos(radians({lat})) * sin{d} * cos(radians({brg}))))))"
    )


def moved_lon(lat: str, lon: str, brg: str, km: str) -> str:
    d = f"(({km}) / {R})"
    s = f"(sin(radians({lat})) * cos{d} + cos(radians({lat})) * sin{d} * cos(radians({brg})))"
    dl = f"atan2(sin(radians({brg})) * sin{d} * cos(radians({lat})), cos{d} - sin(radians({lat})) * {s})"
    return wrap(f"({lon}) + degrees({dl})")


def us(ts: str) -> str:
    return f"epoch_us({ts})"


# Cell and slot a ping falls in, by the binding rules of the fixtures.
PING_CELL = (
    "cast(vessel_id % 40 as int) as cell_i, cast(ping_id % 10 as int) as cell_j,"
    " cast(floor(t_s / 216000.0e0) + 1 as int) as slot"
)
