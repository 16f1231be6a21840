"""A sample database: a small shop with keys, checks, defaults and indexes.

The schema is here; the rows come from a folder of Parquet tables.
"""

from __future__ import annotations

from quillon.session import Engine

SCHEMA = """
CREATE TABLE areas (area_id integer PRIMARY KEY, area text NOT NULL);
CREATE TABLE countries (
    country_id integer PRIMARY KEY,
    country text NOT NULL,
    area_id integer NOT NULL REFERENCES areas (area_id)
);
CREATE TABLE clients (
    client_id bigint PRIMARY KEY,
    client text NOT NULL,
    country_id integer NOT NULL REFERENCES countries (country_id),
    balance double precision NOT NULL DEFAULT 0.0,
    segment text
);
CREATE TABLE goods (
    good_id bigint PRIMARY KEY,
    good text NOT NULL,
    size integer CHECK (size > 0),
    price double precision NOT NULL CHECK (price >= 0.0)
);
CREATE TABLE notes (note_id serial PRIMARY KEY, client_id bigint REFERENCES clients (client_id), note text, made timestamp with time zone NOT NULL DEFAULT now());
CREATE UNIQUE INDEX areas_by_name ON areas USING btree (area);
CREATE INDEX clients_by_segment ON clients USING hash (segment);
CREATE INDEX large_goods ON goods (size DESC, price) WHERE size > 40;
"""

DATA = """
INSERT INTO areas SELECT r_regionkey, r_name FROM region;
INSERT INTO countries SELECT n_nationkey, n_name, n_regionkey FROM nation;
INSERT INTO clients SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer;
INSERT INTO goods SELECT p_partkey, p_name, p_size, p_retailprice FROM part;
"""


def load(engine: Engine, what: str = "all") -> None:
    """what: schema, data (into a loaded schema) or all. Data need the engine's folder."""
    if what in ("schema", "all"):
        engine.script(SCHEMA)
    if what in ("data", "all"):
        engine.script(DATA)
