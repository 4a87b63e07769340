"""Readers, decoders and writers of the wire formats."""

from .advisory import advisory_rejects, decode_advisories, decode_advisory
from .conflict import conflict_rejects, decode_conflict_group, part_key, read_part_key, split_conflict_groups
from .messages import read_messages, read_stream, write_messages
from .status import decode_status, status_rejects
from .utility import load_utility
from .xml import (
    decode_operation_messages_xml,
    decode_operations_xml,
    decode_positions_xml,
    operation_message_rejects,
    operation_rejects,
    position_rejects,
    read_operation_message_rejects,
    read_operation_messages_xml,
    read_operation_rejects,
    read_operations_xml,
    read_position_rejects,
    read_positions_xml,
    to_planar,
    xml_documents,
)

__all__ = [
    "advisory_rejects",
    "conflict_rejects",
    "decode_advisories",
    "decode_advisory",
    "decode_conflict_group",
    "decode_operation_messages_xml",
    "decode_operations_xml",
    "decode_positions_xml",
    "decode_status",
    "load_utility",
    "operation_message_rejects",
    "operation_rejects",
    "part_key",
    "position_rejects",
    "read_messages",
    "read_operation_messages_xml",
    "read_part_key",
    "read_operations_xml",
    "read_operation_message_rejects",
    "read_operation_rejects",
    "read_position_rejects",
    "read_positions_xml",
    "read_stream",
    "split_conflict_groups",
    "status_rejects",
    "to_planar",
    "write_messages",
    "xml_documents",
]
