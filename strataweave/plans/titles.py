"""Titles of weakness classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: the public registry's titles by number
TITLES = {
    "100": "Function Default Visibility",
    "101": "Integer Overflow and Underflow",
    "102": "Outdated Compiler Version",
    "103": "Floating Pragma",
    "104": "Unchecked Call Return Value",
    "105": "Unprotected Ether Withdrawal",
    "106": "Unprotected SELFDESTRUCT Instruction",
    "107": "Reentrancy",
    "108": "State Variable Default Visibility",
    "109": "Uninitialized Storage Pointer",
    "110": "Assert Violation",
    "111": "Use of Deprecated Solidity Functions",
    "112": "Delegatecall to Untrusted Callee",
    "113": "DoS with Failed Call",
    "114": "Transaction Order Dependence",
    "115": "Authorization through tx.origin",
    "116": "Block values as a proxy for time",
    "117": "Signature Malleability",
    "118": "Incorrect Constructor Name",
    "119": "Shadowing State Variables",
    "120": "Weak Sources of Randomness from Chain Attributes",
    "121": "Missing Protection against Signature Replay Attacks",
    "122": "Lack of Proper Signature Verification",
    "123": "Requirement Violation",
    "124": "Write to Arbitrary Storage Location",
    "125": "Incorrect Inheritance Order",
    "126": "Insufficient Gas Griefing",
    "127": "Arbitrary Jump with Function Type Variable",
    "128": "DoS With Block Gas Limit",
    "129": "Typographical Error",
    "130": "Right-To-Left-Override control character (U+202E)",
    "131": "Presence of unused variables",
    "132": "Unexpected Ether balance",
    "133": "Hash Collisions With Multiple Variable Length Arguments",
    "134": "Message call with hardcoded gas amount",
    "135": "Code With No Effects",
    "136": "Unencrypted Private Data On-Chain",
}


def title(swc: Column) -> Column:
    """``SWC-107`` or ``107`` to its title, else ``unknown``."""
    table = F.create_map(*[F.lit(x) for pair in TITLES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.replace(F.upper(swc), F.lit("SWC-"), F.lit(""))), F.lit("unknown"))
