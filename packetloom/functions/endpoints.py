"""Rules on packet endpoints, flags and flow times."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Addresses of public encrypted-DNS resolvers.
RESOLVER_IPS = [
    "8.8.8.8", "8.8.4.4",
    "9.9.9.9", "9.9.9.10", "9.9.9.11",
    "1.1.1.1", "1.0.0.1",
    "149.112.112.10", "149.112.112.112",
    "176.103.130.130", "176.103.130.131",
    "104.16.248.249", "104.16.249.249",
]

# TCP flag bits.
FIN, SYN, RST = 0x01, 0x02, 0x04


def endpoint(ip: Column | str, port: Column | str) -> Column:
    """Endpoint as ``ip:port`` text; the parts keep their own types in ``two_way_key``."""
    return F.concat_ws(":", ip, F.col(port) if isinstance(port, str) else port)


def two_way_key(src_ip: str, src_port: str, dst_ip: str, dst_port: str) -> Column:
    """One key for both directions: the lesser endpoint first, ips compared as text, ports as numbers."""
    a = F.struct(F.col(src_ip).alias("ip"), F.col(src_port).alias("port"))
    b = F.struct(F.col(dst_ip).alias("ip"), F.col(dst_port).alias("port"))
    low, high = F.least(a, b), F.greatest(a, b)
    return F.concat_ws("|", endpoint(low["ip"], low["port"]), endpoint(high["ip"], high["port"]))


def is_control(flags: str) -> Column:
    """Connection set-up or reset packet."""
    return F.col(flags).bitwiseAND(F.lit(SYN | RST)) != 0


def keeps_application_data(flags: str, app_bytes: str, min_bytes: int = 40) -> Column:
    """Packets that flow assembly reads: no control flag, at least ``min_bytes`` application bytes."""
    return ~is_control(flags) & (F.col(app_bytes) >= min_bytes)


def strict_packet_filter(flags: str, payload_bytes: str, frame_bytes: str,
                         src_port: str, dst_port: str) -> Column:
    """The narrower filter: no FIN either, a payload, a frame over 66 bytes, port 443 on one side."""
    return ((F.col(flags).bitwiseAND(F.lit(FIN | SYN | RST)) == 0)
            & (F.col(payload_bytes) > 0) & (F.col(frame_bytes) > 66)
            & ((F.col(src_port) == 443) | (F.col(dst_port) == 443)))


def touches_resolver(client_ip: str, server_ip: str) -> Column:
    """True when either end is a known resolver."""
    return F.col(client_ip).isin(RESOLVER_IPS) | F.col(server_ip).isin(RESOLVER_IPS)
